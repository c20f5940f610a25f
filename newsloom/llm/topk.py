"""Operator 3: exact top-k search, exhaustive and term at a time.

Rows are integer vectors; a component is a term, its weight the component.  The
candidates of a block are held as postings, for each term the rows with a
non-zero weight and those weights.  A block of queries owns a dense score array;
for each term, the queries that use it scatter (their weight x the posting's
weights) into their scores.  Then each query keeps its k best of the block by
partition selection, and the blocks' lists are merged by rank.

Every query meets every block of candidates: the work is the product, in blocks
of bounded memory, and each pair of blocks is a task of its own: both sides are
dealt to as many partitions as there are pairs.  Lists of k per query and block
are all that is shuffled after that.  Where there are few pairs, queries are cut
finer (which adds no work, as a posting is scattered once a query), so that small
tables use all cores too.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part; rows that share a query's id are its own rows; of
repeated query rows the smallest vector asks; repeated candidate rows are
candidates each; vectors of other lengths score over the terms they share; fewer
candidates than k give all of them; a null id takes no part; an empty table
gives an empty table; extra columns are ignored.  Components so large that a
score could pass 2^63 raise an error: no score is wrapped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: Rows of a block of candidates, of a block of queries, and cells of a dense score array.
CANDIDATE_ROWS, QUERY_ROWS, CELLS = 16_384, 4_096, 1 << 20

#: Components are below this, queries of a block at least so many where blocks are cut finer, and pairs of blocks wanted at least.
MOST, LEAST_ROWS, PAIRS = float(1 << 62), 256, 24


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as array<bigint>; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    too_large = F.raise_error(F.lit("a component is too large for exact scores"))
    whole = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < MOST, F.floor(x.cast("double") * scale).cast("long")).otherwise(too_large.cast("long")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), whole)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, short rows ended by zeros (weights of no term)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query_id, vec_id, score) arrays: each query's k best, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    terms = min(queries.shape[1], vectors.shape[1])
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(terms, 1)
    if top >= 2**63:
        raise ValueError("components are too large for exact scores")
    kind = np.int32 if top < 2**31 else np.int64
    postings = []
    for t in range(terms):
        rows = np.flatnonzero(vectors[:, t])
        postings.append((slice(None) if len(rows) == len(ids) else rows, vectors[rows, t].astype(kind)))
    out, step = [], max(1, CELLS // max(1, len(ids)))
    for lo in range(0, len(queries), step):
        block = queries[lo : lo + step].astype(kind)
        scores = np.zeros((len(block), len(ids)), kind)
        for t, (rows, weights) in enumerate(postings):
            asking = np.flatnonzero(block[:, t])
            for q in asking:
                scores[q, rows] += block[q, t] * weights
        own = query_ids[lo : lo + step]
        for q in range(len(block)):
            first, after = np.searchsorted(ids, own[q], "left"), np.searchsorted(ids, own[q], "right")
            mine = np.delete(np.arange(len(ids)), np.s_[first:after]) if after > first else None
            s = scores[q] if mine is None else scores[q, mine]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                held = np.flatnonzero(s >= least)
                held = held[np.lexsort((held, -s[held].astype(np.int64)))][:k]
            else:
                held = np.arange(len(s))
            at = held if mine is None else mine[held]
            out.append((np.full(len(at), own[q]), ids[at], s[held].astype(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds, against all rows."""
    kept = pick(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), quantized(F.col(f"`{vector_col}`"), scale).alias("v"), is_query.alias("asks"))
    kept = kept.where("id is not null and v is not null")
    queries = kept.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    n, n_asking = kept.agg(F.count("*"), F.count_if("asks")).first()
    row_blocks, query_blocks = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-n_asking // QUERY_ROWS))
    if row_blocks * query_blocks < PAIRS:
        query_blocks = max(query_blocks, min(-(-PAIRS // row_blocks), n_asking // LEAST_ROWS))
    pairs = row_blocks * query_blocks
    block = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = kept.select("id", "v", block(row_blocks, 1).alias("rows"), every(query_blocks).alias("asked"))
    asking = queries.select("id", "v", block(query_blocks, 2).alias("asked"), every(row_blocks).alias("rows"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            found = best_of_block(left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"]), k)
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    asking, candidates = (side.repartition(pairs, "rows", "asked") for side in (asking, candidates))
    lists = asking.groupBy("rows", "asked").cogroup(candidates.groupBy("rows", "asked")).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
