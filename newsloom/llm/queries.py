"""Queries opN_<name> and pipeline: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.digests(simhash.dedup(table(spark, sf_dir, "documents")))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.store_and_read(table(spark, sf_dir, "documents"))


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import tokenfile

    return tokenfile.write_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import counts

    docs = table(spark, sf_dir, "documents")
    return counts.rollup_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k").totals()


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.digests(mixing.mix(table(spark, sf_dir, "documents")))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.train_and_score(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_topk": op3_topk,
    "op4_token_counts": op4_token_counts,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_tokenfile": op7_tokenfile,
    "op8_quality": op8_quality,
    "op9_lm": op9_lm,
    "op10_media": op10_media,
    "pipeline": pipeline,
}

#: Of the eleven only this one can be said in SQL: the others hash with XXH64 or CRC-32, tokenize, train or draw.
ORACLES: dict[str, str] = {
    "op3_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
