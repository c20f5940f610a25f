from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.streaming import jobs

AT = datetime(2024, 1, 1)


def stream(spark, path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_feed_dedup_equals_batch(spark, tmp_path):
    rows = [("a", "u1", AT), ("a", "u2", AT), (None, "u1", AT), (None, None, AT), (None, None, AT)]
    s = stream(spark, str(tmp_path / "i"), rows, "guid string, url string, ts timestamp")
    assert drain(jobs.distinct_entries(s, [F.col("guid"), F.col("url")], "ts"), "t_dedup").count() == 3


def test_debounce_and_daily(spark, tmp_path):
    rows = [("r", AT + timedelta(minutes=m), 1) for m in (0, 1, 4, 6)] + [("q", AT, 1), ("r", AT + timedelta(days=40), 1)]
    s = stream(spark, str(tmp_path / "i"), rows, "rule string, ts timestamp, v int")
    got = drain(jobs.debounce(s, "rule", "ts"), "t_bounce", "complete").where("rule = 'r'").orderBy("window_start").collect()
    assert [r.alerts for r in got] == [3, 1, 1]
    daily = drain(jobs.daily_rollup(s, "ts", ["rule"], {"n": F.count("*")}), "t_daily", "complete")
    assert {(str(r.stat_date), r.rule): r.n for r in daily.collect()} == {("2024-01-01", "r"): 4, ("2024-01-01", "q"): 1, ("2024-02-10", "r"): 1}


def test_lookback_against_stored(spark, tmp_path):
    schema = "document_id string, seq long, url string, title string, body_text string, published_at timestamp, source_id string"
    run = jobs.dedup_against(str(tmp_path / "s"))
    first = spark.createDataFrame([("a", 1, "https://e.org/1", "t", "some words", AT, "s")], schema)
    second = spark.createDataFrame([("b", 2, "https://e.org/1", "t", "other words", AT, "s")], schema)
    run(first, 0)
    for _ in range(2):
        run(second, 1)
    got = {r.document_id: (r.status, r.matched_id) for r in spark.read.parquet(str(tmp_path / "s" / "verdicts")).collect()}
    assert got == {"a": ("new_document", None), "b": ("exact_duplicate", "a")} and spark.read.parquet(str(tmp_path / "s" / "articles")).count() == 2


@pytest.mark.parametrize("gap", ["7 days"])
def test_inactivity(spark, tmp_path, gap):
    rows = [("k", AT), ("k", AT + timedelta(days=3)), ("k", AT + timedelta(days=20))]
    s = stream(spark, str(tmp_path / "i"), rows, "k string, ts timestamp")
    got = drain(jobs.inactivity(s, "k", "ts", gap), "t_quiet", "complete").orderBy("first_seen").collect()
    assert [r.n for r in got] == [2, 1]


def test_conditional_get_state(spark, tmp_path):
    rows = [("u", "e1", None, AT), ("u", None, None, AT + timedelta(hours=1)), ("v", None, None, AT)]
    s = stream(spark, str(tmp_path / "i"), rows, "url string, etag string, last_modified string, fetched_at timestamp")
    assert [(r.url, r.etag) for r in drain(jobs.conditional_get(s), "t_cond").collect()] == [("u", "e1")]
