"""Tables: mandatory soft-delete filter, upsert, soft delete, point lookup, archive and graph export."""

from __future__ import annotations

import functools
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def active(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where("deleted_at is null") if "deleted_at" in df.columns else df


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return active(reader.parquet(path))


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Latest row of each key: the highest version wins, of equal versions the change. Plain parquet has no merge, so this is the table to write."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc("_new")))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def soft_delete(df: DataFrame, which: Column, at: Column) -> DataFrame:
    """Set deleted_at where the test holds and it is not set; without that column the rows go. Nothing that fits is no error."""
    if "deleted_at" not in df.columns:
        return df.where(~F.coalesce(which, F.lit(False)))
    return df.withColumn("deleted_at", F.when(which & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def find_one(df: DataFrame, **equal) -> DataFrame:
    """The row that has these values, as a DataFrame of at most one; more than one raises ValueError."""
    test = F.lit(True)
    for k, v in equal.items():
        test = test & (F.col(k) == F.lit(v))
    found = active(df).where(test).limit(2)
    if found.count() > 1:
        raise ValueError(f"more than one row has {equal}")
    return found


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder URI below the folder in spark.checkpoint.dir, which all executors share.

    Where it is unset a local session gets a folder of its own, kept outside the session's settings; a cluster raises, as
    executors do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base(spark.sparkContext.applicationId)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (made := _SCRATCH.get()) is not None:
        made.append(path)
    return path


#: Folders made within a ``scratch`` block.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Folders that are made within the block are deleted at its end: what is to stay is written elsewhere before."""
    token = _SCRATCH.set([])
    try:
        yield
    finally:
        made = _SCRATCH.get()
        _SCRATCH.reset(token)
        for path in made:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    _filesystem(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def _filesystem(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@functools.lru_cache(maxsize=8)
def _local_base(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="newsloom-")


def settle(df: DataFrame, label: str = "settled", codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back, which cuts lineage. The table goes with the driver, or with a ``scratch`` block."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    _filesystem(df.sparkSession, path).deleteOnExit(df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def archive(df: DataFrame, path: str, time_col: str, before: Column, fmt: str = "parquet") -> None:
    """Export rows older than ``before``, partitioned by month."""
    old = df.where(F.col(time_col) < before).withColumn("month", F.date_format(time_col, "yyyy-MM"))
    old.write.partitionBy("month").mode("append").format(fmt).save(path)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that ``df`` has rows of, and no others: the upsert of daily rows."""
    df.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "neo4j_csv") -> None:
    """Nodes (id, label, name) and edges (source, target, type, weight) as neo4j_csv, json_ld, rdf or graphml.

    The last three are line files: one element a line, so that they are written in
    parallel; graphml files lack the document frame, which ``graphml_frame`` gives.
    """
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    if fmt == "neo4j_csv":
        nodes.select(F.col("id").alias(":ID"), F.col("label").alias(":LABEL"), "name").write.option("header", True).csv(f"{path}/nodes")
        edges.select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.col("type").alias(":TYPE"), "weight").write.option("header", True).csv(f"{path}/edges")
        return
    if fmt == "json_ld":
        n = nodes.select(F.struct(F.col("id").cast("string").alias("@id"), F.col("label").alias("@type"), "name").alias("v"))
        e = edges.select(F.struct(F.col("source").cast("string").alias("@id"), F.col("type").alias("@type"), F.col("target").cast("string").alias("target"), "weight").alias("v"))
        lines = [(n.select(F.to_json("v").alias("value")), "nodes"), (e.select(F.to_json("v").alias("value")), "edges")]
    elif fmt == "rdf":
        uri = lambda c: F.concat(F.lit("<urn:node:"), F.url_encode(c.cast("string")), F.lit(">"))
        text = F.replace(F.replace(F.replace(F.col("name"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        n = nodes.select(F.concat(uri(F.col("id")), F.lit(' <http://www.w3.org/2000/01/rdf-schema#label> "'), text, F.lit('" .')).alias("value"))
        e = edges.select(F.concat(uri(F.col("source")), F.lit(" <urn:type:"), F.url_encode("type"), F.lit("> "), uri(F.col("target")), F.lit(" .")).alias("value"))
        lines = [(n, "nodes"), (e, "edges")]
    elif fmt == "graphml":
        n = nodes.select(F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('"><data key="name">'), xml(F.col("name")), F.lit("</data></node>")).alias("value"))
        e = edges.select(F.concat(F.lit('<edge source="'), xml(F.col("source")), F.lit('" target="'), xml(F.col("target")), F.lit('"/>')).alias("value"))
        lines = [(n, "nodes"), (e, "edges")]
    else:
        raise ValueError(f"unknown format: {fmt}")
    for df, name in lines:
        df.write.text(f"{path}/{name}")


def graphml_frame() -> tuple[str, str]:
    return '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><graph edgedefault="directed">', "</graph></graphml>"
