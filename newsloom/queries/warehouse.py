"""Roll-ups, trends, hierarchies and lifecycles: ``events`` stands for logs, region and nation for a taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.plans import warehouse

from .registry import query

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def events(load):
    return load("events")


def kind(name):
    return F.col("event_type") == name


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS stat_date, count(*) FILTER (event_type = 'purchase') AS new_documents, count(*) FILTER (event_type = 'signup') AS new_events FROM events GROUP BY 1)
SELECT stat_date, new_documents, new_events, CAST(sum(new_documents) OVER (ORDER BY stat_date) AS BIGINT) AS total_documents, CAST(sum(new_events) OVER (ORDER BY stat_date) AS BIGINT) AS total_events FROM d"""
)
def daily_summary_cumulative(load):
    return warehouse.daily_summary(events(load), "ts", {"documents": kind("purchase"), "events": kind("signup")})


@query(
    """SELECT user_id AS source_id, CAST(ts AS DATE) AS stat_date, count(*) FILTER (event_type <> 'error') AS documents_fetched, count(*) FILTER (event_type = 'purchase') AS documents_new,
  count(*) FILTER (event_type = 'view') AS documents_duplicate, count(*) FILTER (event_type = 'error') AS fetch_errors, round(avg(value), 6) AS avg_response_time_ms FROM events GROUP BY 1, 2"""
)
def source_daily_stats(load):
    made = warehouse.source_daily(events(load), "user_id", "ts", kind("error"), kind("purchase"), kind("view"), F.col("value"))
    return made.withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


@query(
    """SELECT CAST(ts AS DATE) AS stat_date, count(*) AS total_jobs_run, count(*) FILTER (event_type <> 'error') AS jobs_succeeded, count(*) FILTER (event_type = 'error') AS jobs_failed,
  CAST(sum(user_id) AS BIGINT) AS total_items_fetched, CAST(sum(event_id % 3) AS BIGINT) AS total_retries, round(avg(value), 6) AS avg_job_duration_ms FROM events GROUP BY 1"""
)
def collector_daily_stats(load):
    made = warehouse.collector_daily(events(load), "ts", ~kind("error"), F.col("user_id"), F.col("event_id") % 3, F.col("value"))
    return made.withColumn("avg_job_duration_ms", F.round("avg_job_duration_ms", 6))


@query(
    """SELECT event_type AS model_id, CAST(ts AS DATE) AS stat_date, count(*) AS requests_total, count(*) FILTER (user_id % 10 <> 0) AS requests_succeeded, count(*) FILTER (user_id % 10 = 0) AS requests_failed,
  CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens, round(sum(value), 4) AS total_cost, round(avg(value), 6) AS avg_latency_ms, round(quantile_cont(value, 0.95), 6) AS p95_latency_ms FROM events GROUP BY 1, 2"""
)
def ai_daily_p95(load):
    made = warehouse.model_daily(events(load), "event_type", "ts", F.col("user_id") % 10 != 0, F.col("user_id"), F.col("event_id") % 100, F.col("value"), F.col("value"))
    return made.withColumns({"total_cost": F.round("total_cost", 4), "avg_latency_ms": F.round("avg_latency_ms", 6), "p95_latency_ms": F.round("p95_latency_ms", 6)})


@query("SELECT user_id AS source_id, CAST(ts AS DATE) AS stat_date, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS reliability FROM events GROUP BY 1, 2")
def source_reliability(load):
    return warehouse.reliability(events(load), "user_id", "ts", ~kind("error")).withColumn("reliability", F.round("reliability", 6))


@query(f"SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 100")
def top_entities(load):
    return warehouse.top_k(events(load), ["user_id"], "ts", as_of(), 30, 100)


@query(f"SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1, 2 ORDER BY n DESC, user_id, event_type LIMIT 50")
def top_events_7d(load):
    return warehouse.top_k(events(load), ["user_id", "event_type"], "ts", as_of(), 7, 50)


@query(
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS stat_date, count(*) AS hits FROM events GROUP BY 1, 2), l AS (SELECT *, lag(hits, 7) OVER (PARTITION BY event_type ORDER BY stat_date) AS hits_before FROM d)
SELECT *, hits - hits_before AS change FROM l"""
)
def keyword_trend_lag(load):
    return warehouse.trend(events(load), "event_type", "ts")


@query("SELECT n_name AS node, count(DISTINCT c_custkey) AS documents, round(count(DISTINCT c_custkey) * 100.0 / (SELECT count(*) FROM customer), 6) AS percent FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def taxonomy_coverage(load):
    labels = load("customer").join(load("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return warehouse.coverage(labels, "n_name", "c_custkey", load("customer")).withColumn("percent", F.round("percent", 6))


TREE = "e AS (SELECT NULL AS p, 'r' || r_regionkey AS c FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


def edges(load):
    of = lambda a, k: F.concat(F.lit(a), F.col(k).cast("string"))
    top = load("region").select(F.lit(None).cast("string").alias("parent_id"), of("r", "r_regionkey").alias("id"))
    mid = load("nation").select(of("r", "n_regionkey").alias("parent_id"), of("n", "n_nationkey").alias("id"))
    low = load("supplier").select(of("n", "s_nationkey").alias("parent_id"), of("s", "s_suppkey").alias("id"))
    return top.unionByName(mid).unionByName(low)


@query(f"WITH RECURSIVE {TREE}, up(ancestor, descendant, depth) AS (SELECT c, c, 0 FROM e UNION ALL SELECT e.p, up.descendant, up.depth + 1 FROM up JOIN e ON up.ancestor = e.c WHERE e.p IS NOT NULL) SELECT ancestor, descendant, depth FROM up")
def taxonomy_closure(load):
    return warehouse.closure(edges(load))


@query("SELECT 'r' || n_regionkey AS ancestor, 'n' || n_nationkey AS descendant, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'r1', 'r1', 0")
def taxonomy_subtree(load):
    return warehouse.subtree(warehouse.closure(edges(load)), "r1", 1)


@query("WITH m AS (SELECT DISTINCT l_orderkey AS d, l_suppkey AS e FROM lineitem) SELECT a.e AS e1, b.e AS e2, count(*) AS frequency FROM m a JOIN m b ON a.d = b.d AND a.e < b.e GROUP BY 1, 2")
def cooccurrence_network(load):
    return warehouse.cooccurrence(load("lineitem"), "l_orderkey", "l_suppkey")


@query("WITH m AS (SELECT l_orderkey AS d, l_suppkey AS e, max(l_discount) AS c FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2) SELECT a.e AS e1, b.e AS e2, count(*) AS frequency, round(avg(least(a.c, b.c)), 6) AS confidence FROM m a JOIN m b ON a.d = b.d AND a.e < b.e GROUP BY 1, 2")
def cooccurrence_confidence(load):
    made = warehouse.cooccurrence(load("lineitem").where("l_orderkey % 3 = 0"), "l_orderkey", "l_suppkey", F.col("l_discount"))
    return made.withColumn("confidence", F.round("confidence", 6))


@query(
    """WITH e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS created, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 7 END AS concluded, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 2 END AS merged FROM orders),
n AS (SELECT created AS d, count(*) AS n FROM e GROUP BY 1), c AS (SELECT concluded AS d, count(*) AS n FROM e WHERE concluded IS NOT NULL GROUP BY 1), m AS (SELECT merged AS d, count(*) AS n FROM e WHERE merged IS NOT NULL GROUP BY 1),
k AS (SELECT l_orderkey AS id, count(*) AS docs FROM lineitem GROUP BY 1), a AS (SELECT created AS d, avg(coalesce(docs, 0)) AS docs FROM e LEFT JOIN k USING (id) GROUP BY 1), d AS (SELECT d FROM n UNION SELECT d FROM c UNION SELECT d FROM m)
SELECT d.d AS stat_date, coalesce(n.n, 0) AS new_events, coalesce(c.n, 0) AS events_concluded, coalesce(m.n, 0) AS events_merged, CAST(round(a.docs, 2) AS DOUBLE) AS avg_documents_per_event, CAST(sum(coalesce(n.n, 0)) OVER (ORDER BY d.d) AS BIGINT) AS total_events
FROM d LEFT JOIN n ON n.d = d.d LEFT JOIN c ON c.d = d.d LEFT JOIN m ON m.d = d.d LEFT JOIN a ON a.d = d.d"""
)
def event_daily_stats(load):
    day = F.to_date("o_orderdate")
    made = load("orders").select(F.col("o_orderkey").alias("event_id"), day.alias("created"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 7)).alias("concluded"), F.when(F.col("o_orderkey") % 5 == 0, F.date_add(day, 2)).alias("merged"))
    links = load("lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("document_id"))
    return warehouse.event_daily(made, links).withColumn("avg_documents_per_event", F.col("avg_documents_per_event").cast("double"))


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(load):
    return warehouse.latest(events(load).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


@query("SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS version_no, coalesce(lag(event_type) OVER w <> event_type, true) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def version_change_lag(load):
    return warehouse.versions(events(load), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "version_no", "changed")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unprocessed_anti_join(load):
    """Orders none of whose lines came back: work without a result."""
    return warehouse.unprocessed(load("orders").select("o_orderkey"), load("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(f"SELECT user_id, max(ts) AS last_seen, max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS concluded FROM events GROUP BY 1")
def event_inactivity(load):
    return warehouse.inactive(events(load), "user_id", "ts", as_of())


STATES = "CASE event_type WHEN 'view' THEN 'identified' WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'concluded' WHEN 'signup' THEN 'merged' ELSE 'archived' END"


@query(
    f"""WITH h AS (SELECT event_id, user_id, ts, {STATES} AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM h)
SELECT event_id, previous, state, previous IS NULL OR (previous || '>' || state) IN ('identified>active', 'identified>merged', 'active>concluded', 'active>merged', 'active>archived', 'concluded>active', 'concluded>archived', 'archived>active') AS valid FROM l"""
)
def lifecycle_transition_check(load):
    h = events(load).select("event_id", "user_id", "ts", F.expr(STATES).alias("state"))
    return warehouse.check_transitions(h, "event", "user_id", ["ts", "event_id"]).select("event_id", "previous", "state", "valid")


@query(
    """WITH m AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d FROM events), f AS (SELECT user_id, event_type, min(d) AS d FROM m GROUP BY 1, 2), n AS (SELECT event_type, d, count(*) AS c FROM f GROUP BY 1, 2), t AS (SELECT event_type, d, count(*) AS c FROM m GROUP BY 1, 2)
SELECT t.event_type AS entity_type, t.d AS stat_date, t.c AS total_mentions, coalesce(n.c, 0) AS new_entities, CAST(sum(coalesce(n.c, 0)) OVER (PARTITION BY t.event_type ORDER BY t.d) AS BIGINT) AS total_entities FROM t LEFT JOIN n ON n.event_type = t.event_type AND n.d = t.d"""
)
def entity_daily_stats(load):
    return warehouse.entity_daily(events(load), "user_id", "event_type", "ts")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01' AND (o_orderstatus = 'O' OR TIMESTAMP '1995-06-01' < o_orderdate + INTERVAL 30 DAY)")
def temporal_validity(load):
    spans = load("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("valid_until"))
    return warehouse.valid_at(spans, F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey < 40 AND l_suppkey > 0 THEN l_suppkey % 5 ELSE l_suppkey END AS supplier FROM lineitem")
def merge_redirection(load):
    # a chain 5k+i -> 5(k-1)+i -> ... -> i
    merges = load("supplier").where("s_suppkey >= 5 and s_suppkey < 40").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") - 5).alias("new"))
    rows = load("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supplier"))
    return warehouse.redirect(rows, merges, "supplier")


@query("WITH c AS (SELECT l_orderkey AS mention, l_partkey AS entity, max(l_discount * 10) AS confidence FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY confidence DESC, entity) AS n FROM c) SELECT mention, entity, round(confidence, 6) AS confidence, confidence >= 0.9 AS resolved FROM r WHERE n = 1")
def disambiguation(load):
    found = load("lineitem").groupBy(F.col("l_orderkey").alias("mention"), F.col("l_partkey").alias("entity")).agg(F.max(F.col("l_discount") * 10).alias("confidence"))
    return warehouse.disambiguate(found, "mention", "entity", "confidence").withColumn("confidence", F.round("confidence", 6))


@query(
    """WITH g AS (SELECT p_partkey, p_name, list_distinct(flatten(list_transform(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM part),
q AS (SELECT list_distinct(flatten(list_transform(regexp_extract_all('red widgit', '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS q)
SELECT p_partkey, p_name, round(len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))), 6) AS similarity FROM g, q WHERE len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) >= 0.3"""
)
def trigram_similarity(load):
    return warehouse.trigram_search(load("part"), "p_name", "red widgit").select("p_partkey", "p_name", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'manual' WHEN doc_id % 3 = 0 THEN 'new_version' WHEN doc_id % 4 = 0 THEN 'edited' WHEN doc_id % 10 < 7 THEN 'low_confidence' END AS trigger FROM documents")
def reclassification_triggers(load):
    k = F.col("doc_id")
    base = F.to_timestamp(F.lit("2024-01-01"))
    rows = load("documents").select(
        "doc_id", (k % 5 == 0).alias("manual"), F.when(k % 3 == 0, "v1").otherwise("v2").alias("taxonomy_version"), F.when(k % 4 == 0, base + F.make_dt_interval(F.lit(1))).otherwise(base).alias("edited_at"), base.alias("classified_at"), ((k % 10) / 10.0).alias("confidence")
    )
    return warehouse.stale(rows, F.lit("v2")).select("doc_id", "trigger")
