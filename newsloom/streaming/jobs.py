"""Streams: feed dedup, alert de-bounce, daily roll-ups, inactivity, conditional-GET state, lookback dedup.

Watermarks bound every state; the default is the duplicate lookback (14 days).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOOKBACK = "14 days"


def distinct_entries(entries: DataFrame, keys: list[Column], ts: str, watermark: str = LOOKBACK) -> DataFrame:
    """First arrival of each key within the watermark; rows without a key share one."""
    keyed = entries.withColumn("_key", F.coalesce(*keys, F.lit("\0none")))
    return keyed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def debounce(alerts: DataFrame, rule: str, ts: str, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """One alert a rule and tumbling window: the first, with how many it stands for."""
    return (
        alerts.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window).alias("w"), F.col(rule))
        .agg(F.min(ts).alias("first_at"), F.count("*").alias("alerts"))
        .select(F.col("w.start").alias("window_start"), rule, "first_at", "alerts")
    )


def daily_rollup(facts: DataFrame, ts: str, by: list[str], measures: dict[str, Column], watermark: str = LOOKBACK) -> DataFrame:
    """Day windows; write in update mode, or append once days are final."""
    return (
        facts.withWatermark(ts, watermark)
        .groupBy(F.window(ts, "1 day").alias("w"), *by)
        .agg(*[v.alias(k) for k, v in measures.items()])
        .select(F.to_date("w.start").alias("stat_date"), *by, *measures)
    )


def inactivity(signs: DataFrame, key: str, ts: str, gap: str = "7 days", watermark: str = LOOKBACK) -> DataFrame:
    """A row for each spell of activity that ended in ``gap`` of silence."""
    return (
        signs.withWatermark(ts, watermark)
        .groupBy(F.session_window(ts, gap).alias("s"), F.col(key))
        .agg(F.count("*").alias("n"), F.max(ts).alias("last_seen"))
        .select(key, F.col("s.start").alias("first_seen"), "last_seen", "n")
    )


def conditional_get(fetches: DataFrame, watermark: str = LOOKBACK) -> DataFrame:
    """(url, etag, last_modified, fetched_at) whenever a URL's validators are set anew. Fetches: url, etag, last_modified, fetched_at.

    A URL's state goes when the watermark has passed its last validators.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else ("", "", 0)
        new = held
        for frame in frames:
            named = frame.assign(etag=frame["etag"].fillna(""), last_modified=frame["last_modified"].fillna("")).astype({"fetched_at": "datetime64[us]"})
            named = named[(named["etag"] != "") | (named["last_modified"] != "")]
            if len(named):
                last = named.sort_values("fetched_at", kind="stable").iloc[-1]
                at = int(last["fetched_at"].value // 1000)
                if at >= new[2]:
                    new = (last["etag"], last["last_modified"], at)
        if new != held:
            state.update(new)
            state.setTimeoutTimestamp(max(new[2] // 1000, state.getCurrentWatermarkMs()) + TIMEOUT_MS)
            yield pd.DataFrame([{"url": key[0], "etag": new[0] or None, "last_modified": new[1] or None, "fetched_at": pd.Timestamp(new[2], unit="us")}])

    return (
        fetches.withWatermark("fetched_at", watermark)
        .groupBy("url")
        .applyInPandasWithState(keep, "url string, etag string, last_modified string, fetched_at timestamp", "etag string, last_modified string, at long", "append", GroupStateTimeout.EventTimeTimeout)
    )


#: How long after its last validators a URL's state stays, once the watermark is there.
TIMEOUT_MS = 1000


def dedup_against(stored: str, config=None):
    """A foreachBatch function: each micro-batch asks for duplicates among the stored articles that its lookback reaches and itself, then is appended with its verdicts.

    Near duplicates are looked for between the batch and the rest only: pairs of two stored articles are never made.
    """
    from newsloom.config import DedupConfig
    from newsloom.plans.dedup import analyze

    c = config or DedupConfig()

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{stored}/articles")
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        known = batch.withColumn("_asks", F.lit(True))
        if there:
            floor = batch.agg(F.min("published_at").alias("m"), F.count_if(F.col("published_at").isNull()).alias("open")).first()
            old = spark.read.parquet(f"{stored}/articles").where(F.col("batch_id") < batch_id).drop("batch_id")
            if floor.m is not None and not floor.open:
                old = old.where(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(floor.m) - F.make_dt_interval(F.lit(c.candidate_lookback_days))))
            known = old.withColumn("_asks", F.lit(False)).unionByName(known)
        verdicts = analyze(known, c, asking=F.col("_asks"))
        # a batch that is run again writes its own partition again
        verdicts.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{stored}/verdicts")
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{stored}/articles")

    return run
