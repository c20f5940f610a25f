import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.config import ClassificationConfig, Taxonomy
from newsloom.plans import classify, registry, warehouse
from newsloom.sources import tables

GOOD = {"theme": ["public_health"], "genre": [], "event_type": [], "stakeholders": [{"name": "N", "type": "police", "role": "r"}], "geography": [], "outcomes": [], "evidence_snippets": ["x"], "confidence": 1}


def answers():
    yield json.dumps(GOOD), True
    yield json.dumps(GOOD | {"rationale": "why"}), True
    yield json.dumps(GOOD | {"rationale": None}), True
    for change in ({"theme": "x"}, {"theme": ["x"]}, {"theme": [1]}, {"genre": [" "]}, {"extra": 1}, {"stakeholders": [{"name": "N"}]}, {"stakeholders": ["N"]}, {"stakeholders": {}}, {"stakeholders": [{"name": "N", "type": "alien", "role": "r"}]}, {"stakeholders": [{"name": "", "type": "police", "role": "r"}]}, {"confidence": True}, {"confidence": "1"}, {"confidence": 1.01}, {"confidence": -0.1}, {"rationale": 3}):
        yield json.dumps(GOOD | change), False
    for k in GOOD:
        yield json.dumps({a: b for a, b in GOOD.items() if a != k}), False
    yield "", False
    yield "[]", False
    yield "{", False


def test_columns_and_python_agree_on_answers(spark):
    rows = list(answers())
    got = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(rows)], "k int, content string")
    for r in classify.validate(got, Taxonomy()).collect():
        content, ok = rows[r.k]
        try:
            classify.check_answer(content, Taxonomy())
            why = None
        except classify.AnswerError as e:
            why = str(e)
        assert (r.error is None) == ok, content
        assert r.error == why and (r.result is not None) == ok


def test_live_retries_and_fallback(spark):
    rows = spark.createDataFrame([("a", "t", "b"), ("b", "t", "b"), ("c", "t", "b")], "article_id string, title string, body_text string")
    good = json.dumps(GOOD)

    def client(system, user, model):
        title = user.split('"article_id"')[0]
        if model == "main":
            raise classify.ClientError("timeout")
        return good if title else "{"

    out = classify.run_live(classify.prompts(rows, Taxonomy()), client, ClassificationConfig(model="main", fallback_models=["spare"], max_retries=1), Taxonomy()).collect()
    assert {(r.status, r.model, r.retries, r.calls) for r in out} == {("classified", "spare", 1, 3)}
    with pytest.raises(ValueError):
        classify.prompts(rows, Taxonomy(), "none")


SOURCES = "id long, name string, domain string, url string, source_type_id long, created_at timestamp, deleted_at timestamp, metadata string"


def test_listing(spark):
    rows = [(k, f"Source {k}", f"d{k}.org", f"https://d{k}.org", k % 2, None if k == 3 else datetime(2024, 1, 1 + k), datetime(2024, 1, 1) if k == 5 else None, json.dumps({"tags": ["a"] if k % 2 else ["a", "b"], "country": "IN" if k < 4 else "US"})) for k in range(8)]
    df = spark.createDataFrame(rows, SOURCES)
    page, total = registry.list_sources(df, page=0, page_size=500)
    assert total == 7 and [r.id for r in page.collect()] == [0, 1, 2, 4, 6, 7, 3]
    page, total = registry.list_sources(df, tags=["a", "b"], country="IN", sort_direction="desc")
    assert [r.id for r in page.collect()] == [2, 0] and total == 2
    page, _ = registry.list_sources(df, search="SOURCE _", sort_by="nothing", page=2, page_size=3)
    assert [r.id for r in page.collect()] == [3, 4, 6]
    assert registry.list_sources(df, none_such="x")[1] == 0
    with pytest.raises(ValueError):
        tables.find_one(df.withColumn("k", F.lit(1)), k=1)
    assert tables.find_one(df, id=5).count() == 0


def test_create_and_enable(spark):
    base = spark.createDataFrame([(1, "A", "a.org", "https://a.org", 1, None, None, "{}")], SOURCES)
    new = spark.createDataFrame([(2, "https://www.b.org/x", None, 1, "rss", "rss", ["rss"], "{}"), (3, "https://a.org", None, 2, "rss", "rss", ["rss"], "{}"), (4, "https://www.a.org/y", None, 1, "website", "w", ["rss"], '{"priority": 11}')], "id long, url string, domain string, source_type_id long, type_code string, type_slug string, capabilities array<string>, metadata string")
    good, bad = registry.create_sources(base, new)
    assert [r.domain for r in good.collect()] == ["b.org"]
    why = {r.id: r.violations for r in bad.collect()}
    assert why[3] == ["url: exists"] and len(why[4]) == 3
    assert json.loads(registry.set_enabled(base, 1, True).first().metadata) == {"enabled": "true"}


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "p", "A & B"), (2, "p", 'C "q"')], "id int, label string, name string")
    edges = spark.createDataFrame([(1, 2, "knows", 0.5)], "source int, target int, type string, weight double")
    for fmt in ("neo4j_csv", "json_ld", "rdf", "graphml"):
        tables.export_graph(nodes, edges, f"{tmp_path}/{fmt}", fmt)
        assert spark.read.text(f"{tmp_path}/{fmt}/nodes").count() >= 2
    with pytest.raises(ValueError):
        tables.export_graph(nodes, edges, str(tmp_path), "x")
    facts = spark.createDataFrame([(datetime(2024, 1, 5), 1), (datetime(2024, 2, 5), 2)], "ts timestamp, v int")
    tables.archive(facts, f"{tmp_path}/old", "ts", F.lit("2024-02-01").cast("timestamp"))
    assert spark.read.parquet(f"{tmp_path}/old").select("month").first().month == "2024-01"
    by = facts.withColumn("d", F.to_date("ts"))
    tables.overwrite_partitions(by, f"{tmp_path}/daily", "d")
    tables.overwrite_partitions(by.where("v = 2").withColumn("v", F.lit(9)), f"{tmp_path}/daily", "d")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/daily").collect()) == [1, 9]


def test_merge_cycles_and_deep_moves(spark):
    rows = spark.createDataFrame([(1,), (3,)], "e long")
    assert sorted(r.e for r in warehouse.redirect(rows, spark.createDataFrame([(1, 2), (2, 4)], "old long, new long"), "e").collect()) == [3, 4]
    with pytest.raises(ValueError):
        warehouse.redirect(rows, spark.createDataFrame([(1, 2), (2, 1)], "old long, new long"), "e").count()


def test_event_daily(spark):
    d = lambda x: datetime(2024, 1, x)
    events = spark.createDataFrame([(1, d(1), d(3), None), (2, d(1), None, d(2)), (3, d(3), None, None)], "event_id int, created timestamp, concluded timestamp, merged timestamp")
    links = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "event_id int, document_id int")
    got = {str(r.stat_date): (r.new_events, r.events_concluded, r.events_merged, r.total_events, r.avg_documents_per_event and float(r.avg_documents_per_event)) for r in warehouse.event_daily(events, links).collect()}
    assert got == {"2024-01-01": (2, 0, 0, 2, 1.0), "2024-01-02": (0, 0, 1, 2, None), "2024-01-03": (1, 1, 0, 3, 1.0)}


def test_bloom_filters_merge_and_never_lose_a_key(spark):
    from newsloom.plans import bloom

    n = bloom.buckets_for(2000)
    half = lambda k: bloom.build(spark.range(2000).where(f"id % 2 = {k}"), "id", n)
    both = bloom.merge(half(0), half(1))
    assert bloom.may_hold(spark.range(2000), "id", both, n).count() == 2000
    others = bloom.may_hold(spark.range(10_000, 20_000), "id", both, n).count()
    assert others < 600
    assert bloom.may_hold(spark.createDataFrame([(None,), (1,)], "id long"), "id", both.limit(0), n).count() == 0


def test_counters_are_observed_and_handed_to_sinks(spark):
    from newsloom.operators import fetch

    rows = [(10, 1.0, 1, False, None, None), (None, 3.0, None, True, "blocked_by_robots_txt", "x")]
    df = spark.createDataFrame(rows, "content_length int, elapsed_ms double, redirect_count int, not_modified boolean, filtered_reason string, error string")
    seen, watch = [], None
    kept, watch = fetch.observed(df, "batch")
    assert kept.count() == 2
    fetch.report(watch, "batch", [lambda name, c: seen.append((name, c))])
    want = {"documents_collected": 2, "bytes_downloaded": 10, "average_latency_ms": 2.0, "redirect_count": 1, "not_modified_count": 1, "robots_blocked_count": 1, "content_type_filtered_count": 0, "error_count": 1}
    assert seen == [("batch", want)]
    assert fetch.metrics(df).first().asDict() == want


def test_look_ups_know_their_fields(spark):
    from newsloom.plans import registry

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, slug string")
    assert registry.look_up(df, "source_type", slug="b").first().id == 2
    with pytest.raises(ValueError):
        registry.look_up(df, "source_type", url="b")


def test_tables_go_with_their_block(spark):
    from newsloom.sources import tables

    with tables.scratch(spark):
        made = tables.settle(spark.range(3))
        path = made.inputFiles()[0].removeprefix("file://")
        assert made.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_cooccurrence_pairs_lists_and_joins_nothing(spark, capsys, monkeypatch):
    from itertools import combinations

    from newsloom.plans import warehouse

    monkeypatch.setattr(warehouse, "MENTIONS_A_TASK", 10)
    rows = [(d, e, ((d + e) % 7) / 8) for d in range(12) for e in range(d % 5 + 1) for _ in range(2)] + [(None, 1, 0.5), (3, None, 0.5)]
    made = warehouse.cooccurrence(spark.createDataFrame(rows, "d long, e long, c double"), "d", "e", F.col("c"))
    made.explain()
    shown = capsys.readouterr().out
    assert "Join" not in shown and "REPARTITION_BY_NUM" in shown
    want = {}
    for d in range(12):
        for a, b in combinations(range(d % 5 + 1), 2):
            want.setdefault((a, b), []).append(min((d + a) % 7, (d + b) % 7) / 8)
    assert {(r.e1, r.e2): (r.frequency, round(r.confidence, 9)) for r in made.collect()} == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}
