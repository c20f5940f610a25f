"""A training corpus from ``documents``: filter, dedup, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows as Parquet to the shared folder and hands the next stage what
it reads from there.  All stages but the last return the columns of documents.

* quality: documents that the classifier rejects go.
* simhash: of each group of near copies (five-word shingles, Jaccard .8 or more,
  verified on the whole texts) the document with the smallest id stays; candidates
  come from operator 6's index and, for links its bits do not guarantee, from
  prefixes, see ``newsloom.llm.shingles``.
* secrets: spans are replaced by ``[SECRET]``, documents stay; ``n_chars`` follows.
* mixing: each source is drawn to its target in whole documents; a document drawn
  twice is two rows.
* bpe: ids of every text, packed, with digests of the ids and of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, mixing, quality, secrets, shingles
from newsloom.sources.tables import discard, scratch, shared_dir

#: No SQL form: training, sampling and tokenizing have none.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with scratch(spark):  # what a stage wrote on its way goes when its rows are written
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
