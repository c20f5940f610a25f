"""Streams over files, run until they have read what is there; SQL has the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.tables import shared_dir
from newsloom.streaming import jobs

from .registry import query


def stream(load, name: str = "events") -> DataFrame:
    """A table as a stream, its time stamp in the session's zone."""
    table = load(name)
    path = table.inputFiles()[0]
    folder = path.rpartition("/")[0]
    reader = table.sparkSession.readStream.schema(table.schema)
    # a table that is one file lies beside others; one that is a folder holds its parts only
    made = reader.parquet(folder) if folder.endswith(".parquet") else reader.option("pathGlobFilter", path.rpartition("/")[2]).parquet(folder)
    return made.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives: all rows it appended, or in complete mode the last state."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        at = path if mode == "append" else f"{path}/rows"
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}" if mode == "append" else at)

    running = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(path if mode == "append" else f"{path}/rows").select(*df.columns)


@query("SELECT CAST(ts AS DATE) AS stat_date, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1, 2")
def stream_daily_rollup(load):
    return drained(jobs.daily_rollup(stream(load), "ts", ["event_type"], {"n": F.count("*"), "users": F.sum("user_id")}), "complete")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, min(ts) AS first_at, count(*) AS alerts FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2")
def stream_debounce(load):
    made = drained(jobs.debounce(stream(load).where(F.col("event_type").isin("error", "signup")), "event_type", "ts"), "complete")
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.col("first_at").cast("timestamp_ntz").alias("first_at"), "alerts")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_distinct_entries(load):
    """The first arrival of each key; all of this table lies within the watermark of one another or 30 days, so the batch form is one row a key."""
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    return drained(jobs.distinct_entries(stream(load), [key], "ts", "60 days"), "append").select("user_id", "event_type")


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM o)
SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, spell"""
)
def stream_inactivity(load):
    """Spells of activity that end in a day of silence."""
    made = drained(jobs.inactivity(stream(load), "user_id", "ts", "1 day"), "complete")
    return made.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")], "n")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS url, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END AS etag, CASE WHEN event_id % 2 = 0 THEN 'm' || event_id END AS last_modified, ts AS fetched_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0) WHERE n = 1"""
)
def stream_conditional_get(load):
    k = F.col("event_id")
    rows = stream(load).select(F.col("user_id").cast("string").alias("url"), F.when(k % 3 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("etag"), F.when(k % 2 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("last_modified"), F.col("ts").alias("fetched_at"))
    made = drained(jobs.conditional_get(rows), "append")
    last = made.groupBy("url").agg(F.max_by(F.struct("etag", "last_modified", "fetched_at"), "fetched_at").alias("s"))
    return last.select("url", "s.etag", "s.last_modified", F.col("s.fetched_at").cast("timestamp_ntz").alias("fetched_at"))
