"""URLs, fetches, feeds and HTML over ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.config import RetryPolicy
from newsloom.functions import url
from newsloom.operators import feeds, fetch
from newsloom.operators.html import extract_articles

from .registry import query

BARE = "regexp_extract({0}, '^[a-z]+://([^/?#]*)([^?#]*)', {1})"
HOST, PATH = BARE.format("url", 1), BARE.format("url", 2)
SCHEME = "regexp_extract(url, '^([a-z]+):', 1)"
QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
#: the pages' only query is page=2&ref=x: ref goes
KEPT = f"CASE WHEN {QUERY} = 'page=2&ref=x' THEN '?page=2' ELSE '' END"
CUT = f"CASE WHEN length({PATH}) > 1 THEN regexp_replace({PATH}, '/+$', '') ELSE {PATH} END"


@query(
    f"""SELECT page_id, {SCHEME} || '://' || lower({HOST}) || {CUT} || {KEPT} AS article_url,
  {SCHEME} || '://' || lower({HOST}) || CASE WHEN {PATH} = '' THEN '/' ELSE {CUT} END || {KEPT} AS identity_url,
  {SCHEME} || '://' || {HOST} || regexp_replace({PATH}, '/+$', '') || {KEPT} AS fetch_url,
  {SCHEME} || '://' || lower({HOST}) || CASE WHEN {PATH} = '' THEN '/' ELSE {CUT} END || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END AS feed_url FROM pages"""
)
def url_canonicalize(load):
    u = F.col("url")
    return load("pages").select("page_id", url.article_url(u).alias("article_url"), url.identity_url(u).alias("identity_url"), url.fetch_url(u).alias("fetch_url"), url.feed_url(u).alias("feed_url"))


@query(f"SELECT page_id, regexp_replace(lower({HOST}), '^www\\.', '') AS domain, page_id % 3 <> 1 AS valid FROM pages")
def domain_normalize(load):
    """Of the pages' URLs; a third of them are checked without their scheme, or with another."""
    u = F.col("url")
    bent = F.when(F.col("page_id") % 3 == 1, F.when(F.col("page_id") % 2 == 0, F.regexp_replace(u, "^[a-z]+:", "")).otherwise(F.regexp_replace(u, "^[a-z]+:", "ftp:"))).otherwise(u)
    return load("pages").select("page_id", url.domain(u).alias("domain"), url.is_source_url(bent).alias("valid"))


TYPE_SQL = "CASE event_type WHEN 'click' THEN 'text/html; charset=utf-8' WHEN 'view' THEN 'Application/XHTML+xml' WHEN 'error' THEN NULL ELSE 'image/png' END"


@query(f"SELECT event_id, {TYPE_SQL} AS content_type FROM events WHERE event_type NOT IN ('purchase', 'signup')")
def content_type_filter(load):
    rows = load("events").select("event_id", F.expr(TYPE_SQL).alias("content_type"))
    return rows.where(fetch.type_allowed(F.col("content_type"), ["text/html", "application/xhtml+xml"]))


@query(
    """SELECT user_id, count(*) AS documents_collected, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes_downloaded, round(avg(value), 6) AS average_latency_ms, CAST(sum(event_id % 2) AS BIGINT) AS redirect_count,
  count(*) FILTER (event_id % 7 = 0) AS not_modified_count, count(*) FILTER (event_type = 'signup') AS robots_blocked_count, count(*) FILTER (event_type = 'view') AS content_type_filtered_count, count(*) FILTER (event_type = 'error') AS error_count FROM events GROUP BY 1"""
)
def fetch_metrics(load):
    k = F.col("event_id")
    rows = load("events").select(
        "user_id", F.octet_length("props").cast("long").alias("content_length"), F.col("value").alias("elapsed_ms"), (k % 2).alias("redirect_count"), (k % 7 == 0).alias("not_modified"),
        F.when(F.col("event_type") == "signup", "blocked_by_robots_txt").when(F.col("event_type") == "view", "content_type_not_allowed").alias("filtered_reason"), F.when(F.col("event_type") == "error", "failed").alias("error"),
    )
    return fetch.metrics(rows, ["user_id"]).withColumn("average_latency_ms", F.round("average_latency_ms", 6))


@query(
    """WITH a AS (SELECT user_id AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_type = 'error' OR event_type = 'view' AS bad, event_type = 'error' AS again, CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 404 ELSE 200 END AS status FROM events),
s AS (SELECT source_id, min(attempt) FILTER (NOT (bad AND again)) AS stop FROM a GROUP BY 1), m AS (SELECT a.* FROM a JOIN s USING (source_id) WHERE attempt <= 3 AND attempt <= coalesce(stop, 3))
SELECT source_id, NOT arg_max(bad, attempt) AS success, count(*) - 1 AS retry_count, CAST(count(*) AS BIGINT) AS bytes_downloaded, array_to_string(list(status ORDER BY attempt), ',') AS http_statuses, CAST(CASE count(*) WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS DOUBLE) AS backoff_seconds FROM m GROUP BY 1"""
)
def retry_replay(load):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", 404).otherwise(200)
    rows = load("events").select(F.col("user_id").alias("source_id"), n.alias("attempt"), status.alias("status"), F.lit(None).cast("string").alias("error_code"), F.lit(False).alias("retryable"), F.lit(1).alias("bytes"), F.col("value").alias("duration_ms"))
    made = fetch.replay_collection(rows, RetryPolicy(backoff_seconds=1.0, backoff_multiplier=2.0))
    return made.select("source_id", "success", "retry_count", F.col("bytes_downloaded").cast("long").alias("bytes_downloaded"), F.array_join(F.transform("http_statuses", lambda x: x.cast("string")), ",").alias("http_statuses"), "backoff_seconds")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS if_none_match, CASE WHEN event_id % 2 = 0 THEN 'm' || event_id END AS if_modified_since, event_id % 5 = 0 AS fresh FROM events")
def conditional_headers(load):
    k = F.col("event_id")
    etag, changed = F.when(k % 3 == 0, F.concat(F.lit("e"), k.cast("string"))), F.when(k % 2 == 0, F.concat(F.lit("m"), k.cast("string")))
    made = fetch.request_headers(etag, changed)
    expires = F.when(k % 5 == 0, F.lit("2024-03-01T00:00:00Z")).otherwise(F.lit("soon"))
    get = lambda n: F.try_element_at(made, F.lit(n))
    return load("events").select("event_id", get("If-None-Match").alias("if_none_match"), get("If-Modified-Since").alias("if_modified_since"), fetch.cache_fresh(expires, F.to_timestamp(F.lit("2024-02-01"))).alias("fresh"))


@query(
    """WITH p AS (SELECT page_id // 10 AS source_id, page_id % 10 AS n, * FROM pages), e AS (SELECT source_id, n, url, CASE WHEN n % 4 = 3 THEN n - 1 ELSE n END AS guid_no FROM p)
SELECT CAST(source_id AS VARCHAR) AS source_id, CAST(e.n AS INTEGER) AS position, 'g' || guid_no AS guid, e.url AS original_url FROM e WHERE n % 4 <> 3 OR n - 1 NOT IN (SELECT n FROM e f WHERE f.source_id = e.source_id)"""
)
def feed_parse(load):
    n = F.col("page_id") % 10
    esc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit("<item><title>t</title><guid>g"), F.when(n % 4 == 3, n - 1).otherwise(n).cast("string"), F.lit("</guid><link>"), esc, F.lit("</link></item>"))
    made = load("pages").groupBy(F.floor(F.col("page_id") / 10).alias("source_id")).agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), item.alias("i")))).alias("items"))
    xml = F.concat(F.lit("<rss><channel><title>f</title><link>http://f.example.org/</link>"), F.array_join(F.transform("items", lambda x: x["i"]), ""), F.lit("</channel></rss>"))
    rows = made.select("source_id", F.lit("http://f.example.org/feed").alias("url"), F.encode(xml, "UTF-8").alias("content"))
    return feeds.collect(rows).select("source_id", "position", "guid", "original_url")


@query()
def html_extract(load):
    made = extract_articles(load("pages"))
    return made.select("page_id", "url", "title", "language", "strategy_used", "word_count", F.size("paragraphs").alias("paragraphs"), F.sha2("body_text", 256).alias("body_hash"))


@query()
def html_quality(load):
    made = extract_articles(load("pages"))
    return made.select("page_id", "missing_title", "missing_author", "missing_date", "missing_body", "content_length", F.round("boilerplate_ratio", 4).alias("boilerplate_ratio"), F.round("quality_score", 4).alias("quality_score"), F.array_join("warnings", "; ").alias("warnings"))
