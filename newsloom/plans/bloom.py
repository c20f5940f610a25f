"""A Bloom filter over keys as a table of bitmaps, for a pre-check before an exact look-up.

A key sets ``HASHES`` bits of ``buckets`` bitmaps of 32,768 bits each; a bitmap is a
row, so a filter of any size is a table and is built by one aggregate.  Keys that
have all their bits may be known; all others are not, for certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap (fixed by the engine), and bits a key sets.
BITMAP_BITS, HASHES = 32_768, 4


def buckets_for(keys: int, bits_per_key: int = 10) -> int:
    return max(1, -(-keys * bits_per_key // BITMAP_BITS))


def _places(key: Column, buckets: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(buckets * BITMAP_BITS)) for k in range(HASHES)])


def build(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, bits). Null keys set nothing."""
    bits = keys.where(F.col(key).isNotNull()).select(F.explode(_places(F.col(key), buckets)).alias("p"))
    bucket = F.floor(F.col("p") / BITMAP_BITS).alias("bucket")
    return bits.groupBy(bucket).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(BITMAP_BITS))).alias("bits"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """The filter of both sets of keys; they have the same number of buckets."""
    return left.unionByName(right).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def may_hold(rows: DataFrame, key: str, bloom: DataFrame, buckets: int) -> DataFrame:
    """The rows whose key may be known, each once. Distinct keys meet the bitmaps, so a key's rows cost one look-up."""
    asked = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    bits = asked.select("k", F.explode(_places(F.col("k"), buckets)).alias("p")).withColumn("bucket", F.floor(F.col("p") / BITMAP_BITS))
    at = F.pmod("p", F.lit(BITMAP_BITS))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(b, cast(pmod(p, 8) as int)) & 1") == 1
    found = bits.join(bloom, "bucket", "left").withColumn("b", F.coalesce(byte, F.lit(0))).groupBy("k").agg(F.min(is_set.cast("int")).alias("all"))
    return rows.join(found.where("all = 1").select(F.col("k").alias(key)), key, "left_semi")
