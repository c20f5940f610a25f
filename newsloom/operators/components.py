"""Joins on hot keys, and connected components for groups of any size.

``join_hot`` joins rows with a table of one row a key that also says how many
rows the key has.  Keys above a share of the total are at most ``HOT_SHARE`` in
number: their rows are broadcast and the rows that have them stay where they
are; all other keys meet by a shuffle.  No task gets the rows of a hot key.

``connected`` finds components by alternating large-star and small-star rounds,
each a table in the shared folder; hubs are hot keys and joined as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.tables import settle

#: Keys with more than total / HOT_SHARE rows (and more than HOT_LEAST) are hot: fewer than HOT_SHARE of them can be.
HOT_SHARE, HOT_LEAST = 256, 1000


def join_hot(left: DataFrame, right: DataFrame, keys: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join; ``right`` has one row a key, ``weight`` counts the rows of ``left`` that have it, and ``total`` all of them."""
    keys = [keys] if isinstance(keys, str) else keys
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(weight) > limit))
    cold = right.where(F.col(weight) <= limit)
    rest = left.join(F.broadcast(right.where(F.col(weight) > limit).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(cold, keys)).drop(weight)


def _to_least(rows: DataFrame, least: DataFrame, most: int, total: int) -> DataFrame:
    """``rows`` (u, v) with the m of their u. Where no node is a hub, which one look at the degrees tells, a plain join does."""
    if most <= max(HOT_LEAST, total // HOT_SHARE):
        return rows.join(least.drop("n"), "u")
    return join_hot(rows, least, "u", "n", total)


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of an edge list (a, b): root is the least node of its component. The driver sees a few sums a round."""
    pairs = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    state = None
    while True:
        # a node's degree is at most its edges as the larger and as the smaller one; hubs of stars are smaller ones
        ends = pairs.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        *now, most = ends.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if now == state or not now[0]:
            break
        state, total = now, now[0]
        # large star: neighbours above a node go to the smallest of its neighbourhood
        up = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = pairs.select("u", "v").unionByName(up)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = _to_least(up, least, most, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _to_least(large, least, most, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
