"""Fetched pages and feeds as data: headers, filters, robots, decoding, metrics, retries.

Network calls stay outside Spark; these operators take tables of responses.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.config import RetryPolicy
from newsloom.functions.dates import backoff_seconds, parse_iso
from newsloom.functions.url import fetch_url

#: Statuses of a feed fetch that are worth another try.
RETRYABLE = (408, 429)


def cache_fresh(expires: Column, as_of: Column) -> Column:
    """The cached copy is still good; an unreadable date is not."""
    return F.coalesce(parse_iso(expires) > as_of, F.lit(False))


def request_headers(etag: Column, last_modified: Column, custom: Column | None = None) -> Column:
    """Conditional headers for those that are set, then custom ones, which win."""
    both = F.map_from_arrays(F.array(F.lit("If-None-Match"), F.lit("If-Modified-Since")), F.array(F.nullif(etag, F.lit("")), F.nullif(last_modified, F.lit(""))))
    held = F.map_filter(both, lambda _, v: v.isNotNull())
    if custom is None:
        return held
    own = F.coalesce(custom, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(own, k)), own)


def feed_status(status: Column) -> Column:
    """'not_modified', 'ok', 'retryable' or 'failed'."""
    return F.when(status == 304, "not_modified").when(status < 400, "ok").when(status.isin(*RETRYABLE) | (status >= 500), "retryable").otherwise("failed")


def feed_health(status: Column) -> Column:
    return F.when(feed_status(status).isin("ok", "not_modified"), "healthy").when(feed_status(status) == "retryable", "degraded").otherwise("failing")


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def type_allowed(content_type: Column, allowed: list[str]) -> Column:
    """A missing content type passes."""
    return content_type.isNull() | (content_type == "") | media_type(content_type).isin(*[a.lower() for a in allowed])


def normalize_fetches(fetches: DataFrame) -> DataFrame:
    """Fetches (requested_url, final_url, status, content, headers, elapsed_ms, redirect_chain, not_modified, filtered_reason, error) as raw documents."""
    header = lambda k: F.try_element_at(F.col("headers"), F.lit(k))
    ct = header("content-type")
    charset = F.regexp_replace(F.trim(F.regexp_extract(ct, "charset=(.*)$", 1)), "^[\"']+|[\"']+$", "")
    has = F.coalesce(F.contains(ct, F.lit("charset=")), F.lit(False))
    length = F.nullif(header("content-length"), F.lit(""))
    return fetches.select(
        fetch_url(F.col("final_url")).alias("url"),
        "requested_url",
        "status",
        "content",
        F.when(has, charset).alias("declared_encoding"),
        F.when(has, F.trim(F.split_part(ct, F.lit(";"), F.lit(1)))).otherwise(ct).alias("content_type"),
        F.when(length.isNotNull(), length.try_cast("long")).otherwise(F.octet_length("content").cast("long")).alias("content_length"),
        "headers",
        "redirect_chain",
        F.size("redirect_chain").alias("redirect_count"),
        "elapsed_ms",
        *[header(k).alias(k.replace("-", "_")) for k in ("transfer-encoding", "server", "cache-control", "expires", "age")],
        "not_modified",
        "filtered_reason",
        "error",
    )


@F.pandas_udf(T.StringType())
def _decode_any(content: pd.Series, encoding: pd.Series) -> pd.Series:
    def one(data, name):
        if data is None:
            return None
        for codec in (name or "utf-8", "utf-8"):
            try:
                return bytes(data).decode(codec)
            except (LookupError, UnicodeDecodeError):
                continue
        return bytes(data).decode("latin-1")

    return pd.Series([one(d, e) for d, e in zip(content, encoding)])


def decode(content: Column, encoding: Column | None = None, content_type: Column | None = None) -> Column:
    """Text of bytes: the given encoding, the charset of the content type, UTF-8, Latin-1, whichever decodes first. Without hints it stays in the JVM."""
    if encoding is None and content_type is None:
        return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    charset = F.nullif(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), "charset=[\"']?([^;\"'\\s]+)", 1)), F.lit(""))
    return _decode_any(content, F.coalesce(F.nullif(encoding, F.lit("")), charset) if encoding is not None else charset)


@F.pandas_udf(T.BooleanType())
def robots_allowed(robots: pd.Series, status: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    """robots.txt text of the origin; no answer, or another status than 200, allows. Each text is read once a batch."""
    read: dict = {}

    def one(text, code, who, where):
        if text is None or code != 200:
            return True
        if text not in read:
            read[text] = RobotFileParser()
            read[text].parse(text.splitlines())
        return read[text].can_fetch(who or "*", where or "")

    return pd.Series([one(*x) for x in zip(robots, status, agent, url)])


def conditional_state(fetches: DataFrame, order: str = "fetched_at") -> DataFrame:
    """(url, etag, last_modified) of the latest response that had either."""
    kept = fetches.where("etag is not null or last_modified is not null")
    return kept.groupBy("url").agg(F.max_by(F.struct("etag", "last_modified"), F.col(order)).alias("s")).select("url", "s.etag", "s.last_modified")


def metrics(documents: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counters over raw documents."""
    return documents.groupBy(*by).agg(
        F.count("*").alias("documents_collected"),
        F.coalesce(F.sum("content_length"), F.lit(0)).alias("bytes_downloaded"),
        F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("average_latency_ms"),
        F.coalesce(F.sum("redirect_count"), F.lit(0)).alias("redirect_count"),
        F.count_if("not_modified").alias("not_modified_count"),
        F.count_if(F.col("filtered_reason") == "blocked_by_robots_txt").alias("robots_blocked_count"),
        F.count_if(F.col("filtered_reason") == "content_type_not_allowed").alias("content_type_filtered_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
    )


#: Takes the counters of a batch: (name, counters by name).
MetricsSink = Callable[[str, dict[str, float]], None]


def observed(documents: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has the counters of ``metrics`` once an action has run over them: no pass of its own."""
    watch = Observation(name)
    tests = {"not_modified_count": F.col("not_modified"), "robots_blocked_count": F.col("filtered_reason") == "blocked_by_robots_txt", "content_type_filtered_count": F.col("filtered_reason") == "content_type_not_allowed", "error_count": F.col("error").isNotNull()}
    sums = {"bytes_downloaded": F.sum("content_length"), "average_latency_ms": F.avg("elapsed_ms"), "redirect_count": F.sum("redirect_count")}
    counters = [F.count(F.lit(1)).alias("documents_collected"), *[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()], *[F.count_if(v).alias(k) for k, v in tests.items()]]
    return documents.observe(watch, *counters), watch


def report(watch: Observation, name: str, sinks: list[MetricsSink]) -> None:
    """Hand the counters of a finished observation to every sink."""
    counters = dict(watch.get)
    for sink in sinks:
        sink(name, counters)


def replay_collection(attempts: DataFrame, policy: RetryPolicy) -> DataFrame:
    """Outcome of each source from its recorded attempts (source_id, attempt from 1, status, error_code, retryable, bytes, duration_ms).

    An attempt succeeds without error and with a status under 400.  After a failure the
    next attempt is made while the status is listed or the error is retryable, and
    attempts are left.
    """
    w = Window.partitionBy("source_id").orderBy("attempt")
    ok = F.col("error_code").isNull() & (F.coalesce("status", F.lit(200)) < 400)
    again = F.coalesce(F.col("status").isin(*policy.retry_on_statuses), F.lit(False)) | F.coalesce("retryable", F.lit(False))
    go_on = F.coalesce(F.min(F.when(~F.col("ok") & F.col("again"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    made = attempts.withColumn("ok", ok).withColumn("again", again).withColumn("made", (go_on == 1) & (F.col("attempt") <= max(1, policy.max_attempts))).where("made")
    last = F.max_by(F.struct("ok", "error_code"), "attempt")
    out = made.groupBy("source_id").agg(
        last.alias("_l"),
        (F.count("*") - 1).alias("retry_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_downloaded"),
        F.sum("duration_ms").alias("duration_ms"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("status").isNotNull(), F.struct("attempt", "status")))), lambda x: x["status"]).alias("http_statuses"),
        F.sum(F.when(F.col("attempt") > 1, backoff_seconds(F.col("attempt") - 1, policy.backoff_seconds, policy.backoff_multiplier)).otherwise(0.0)).alias("backoff_seconds"),
    )
    return out.select("source_id", F.col("_l.ok").alias("success"), F.col("_l.error_code").alias("error_code"), "retry_count", "bytes_downloaded", "duration_ms", "http_statuses", "backoff_seconds")


def polite(df: DataFrame, url: str, partitions: int) -> DataFrame:
    """All URLs of a host in one partition, so that a fetcher per partition bounds the load on a host."""
    return df.repartition(partitions, F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))


class CollectorRegistry:
    """Collectors by key, which is trimmed and lower-cased."""

    def __init__(self):
        self._made: dict = {}

    def register(self, key: str, collector, replace: bool = False) -> None:
        key = key.strip().lower()
        if not key:
            raise ValueError("a collector needs a key")
        if key in self._made and not replace:
            raise ValueError(f"collector exists: {key}")
        self._made[key] = collector

    def get(self, key: str):
        try:
            return self._made[key.strip().lower()]
        except KeyError:
            raise LookupError(f"no collector: {key}") from None

    def unregister(self, key: str) -> None:
        self._made.pop(key.strip().lower(), None)

    def keys(self) -> list[str]:
        return sorted(self._made)
