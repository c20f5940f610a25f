"""Operator 2: mixing sources to target weights by a hypergeometric splitting tree.

Sizes are words.  Sources in code-point order (null last) weigh 3, 1, 2 in
turn and share ``share`` times all words; a target stops at ``most`` times its
source's size and the excess goes to the others by weight until none is above.

Each source's documents stand in a fixed pseudo-random order, so its words form
one sequence, which is cut into blocks of ``block`` words (a parameter, the same
at every size).  A target is a number of full passes over the sequence, a number
of further blocks, and a last block in part: quotas are exact to a word.  The
draws of all sources are dealt to the output shards by a tree: at each node the
draws of the left half of the shards are one multivariate-hypergeometric sample
of what the node has, so every shard ends with the same number of draws (but for
rounding) and a random, exact composition.  Each source's blocks stand in a keyed
random permutation (swap-or-not rounds, exact for any number of blocks, a Column
expression), and the tree's quotas cut that order into disjoint runs, one a
shard: a shard draws the blocks of its run.  Within a shard, draws are shuffled
by a keyed hash.  What a document gives is the sum over the draws that meet it.

Scale: the driver holds one row a source (``MAX_SOURCES`` at most, else an error
is raised) and sources x shards quotas; word positions come from running sums
inside hash buckets of about ``BUCKET_WORDS`` words plus one over the bucket
totals of a source, so a source with a third of all rows is spread over many
buckets.  Rows that repeat (same id and text) are numbered by sums over the
partitions they lie in and spread by their number.  Texts are not shuffled.  All
choices follow from the seed, the ids and the texts: reruns agree.

Defined cases: null text has size 0 and takes nothing; a source of size 0 has
target 0; repeated rows are documents of their own; an empty table gives an
empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick, with_row_key, word_count

#: The weights in turn, the share of all sizes, the most a source is repeated.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2

#: Words of a block and of a hash bucket, sources at most, and rounds of the permutation.
BLOCK_WORDS, BUCKET_WORDS, MAX_SOURCES, ROUNDS = 4096, 1 << 20, 1_000_000, 64

#: Where numpy's hypergeometric sampler ends.
_SAMPLER_MOST = 10**9

PIECE = "array<struct<shard:int,draw:int,place:long,start:long,end:long>>"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source: shares by weight, capped, the excess reshared until none is above."""
    total, goal, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    capped: set[int] = set()
    while len(capped) < len(open_):
        free = [i for i in open_ if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        unit = left / sum(weights[i] for i in free)
        above = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not above:
            for i in free:
                goal[i] = unit * weights[i]
            break
        capped.update(above)
    for i in capped:
        goal[i] = float(most * sizes[i])
    return goal


def _left(rng: np.random.Generator, counts: np.ndarray, part: int) -> np.ndarray:
    """A multivariate-hypergeometric sample, source by source. Beyond the sampler's range a source's count is normal to within a rounding, and kept within what is possible."""
    out, rest, need = np.zeros_like(counts), int(counts.sum()), part
    for k, own in enumerate(map(int, counts)):
        rest -= own
        if rest + own < _SAMPLER_MOST:
            n = int(rng.hypergeometric(own, rest, need)) if own + rest else 0
        else:
            total = own + rest
            spread = need / total * own * (rest / total) * ((total - need) / max(total - 1, 1))
            n = min(max(round(rng.normal(need * own / total, math.sqrt(max(spread, 0.0)))), need - rest, 0), own, need)
        out[k] = n
        need -= n
    return out


def split_quotas(draws: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(sources, shards) counts that add up to ``draws``: the splitting tree."""
    out = np.zeros((len(draws), shards), np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))

    def deal(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid = (lo + hi) // 2
        left = _left(rng, counts, int(counts.sum()) * (mid - lo) // (hi - lo))
        deal(left, lo, mid)
        deal(counts - left, mid, hi)

    deal(np.asarray(draws, np.int64), 0, shards)
    return out


def _hash(*values: int) -> int:
    """The engine's xxhash64 of longs."""
    from xxhash import xxh64_intdigest

    h = 42
    for v in values:
        h = xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def position(block: int, n: int, seed: int, number: int) -> int:
    """Place of a block in its source's permutation, on the driver."""
    for i in range(ROUNDS):
        other = (_hash(seed, number, i) % n - block) % n
        if _hash(seed, number, i, max(block, other)) & 1:
            block = other
    return block


def position_of(block: Column, n: Column, seed: int, number: Column) -> Column:
    """Place of a block in its source's permutation: in each round a block changes places with its partner, or not, by a hash of the two."""

    def turn(at, i):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed).cast("long"), number, i), n) - at, n)
        swap = F.xxhash64(F.lit(seed).cast("long"), number, i, F.greatest(at, other)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), block.cast("long"), turn)


def plan(rows: list[tuple[str | None, int]], seed: int, shards: int, share: float, most: float, weights, block: int) -> list[dict]:
    """Quotas of each source, from (source, size) in order."""
    goal = targets([n for _, n in rows], [weights[k % len(weights)] for k in range(len(rows))], share, most)
    made = []
    for k, ((source, size), target) in enumerate(zip(rows, goal)):
        words, n = round(target), -(-size // block)
        passes, rest = divmod(words, size) if size else (0, 0)
        full, part = divmod(rest, block)
        if passes >= most:  # nothing is left for a further pass
            full = part = 0
        # a short last block among the full draws leaves its lack to the partial one
        tail = size - (n - 1) * block
        if n and tail < block and (full or part):
            at = position(n - 1, n, seed, k)
            if at < full:
                full, part = full + (part + block - tail) // block, (part + block - tail) % block
            elif at == full and part > tail:
                full, part = full + 1, part - tail
        made.append({"source": source, "number": k, "source_size": size, "target": target, "n_blocks": n, "passes": passes, "full": full, "part": part, "block": block})
    draws = np.array([m["n_blocks"] * m["passes"] + m["full"] + (m["part"] > 0) for m in made], np.int64)
    for m, q in zip(made, split_quotas(draws, shards, seed)):
        m["upto"] = np.cumsum(q).tolist()
    return made


SOURCES = "source string, number long, source_size long, target double, n_blocks long, passes int, full long, part long, block long, upto array<long>"


def _spread(sized: DataFrame) -> DataFrame:
    """A hash of its own for each of several equal rows: rows of one partition are counted, numbered after those of the partitions before, and dealt out again."""
    carried = "carried" in sized.columns
    same = [c for c in sized.columns if c != "carried"]
    counts = sized.groupBy(*same).agg(F.collect_list("carried").alias("rows") if carried else F.count("*").alias("n"))
    n = F.size("rows") if carried else F.col("n")
    earlier = Window.partitionBy("h").orderBy("part", "doc", "source", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("base", F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    each = F.posexplode("rows").alias("k", "carried") if carried else F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k")
    dealt = numbered.select(*[c for c in same if c != "part"], "base", each)
    number = (F.col("base") + F.col("k")).cast("long")
    return dealt.withColumn("h", F.when(number == 0, F.col("h")).otherwise(F.xxhash64("h", number))).drop("base", "k")


def mix(
    df: DataFrame,
    seed: int = 20,
    shards: int = 16,
    share: float = SHARE,
    most: float = MOST,
    weights: tuple[float, ...] = WEIGHTS,
    block: int = BLOCK_WORDS,
    whole: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: str | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pieces): one row per document.

    A piece is a run of words [start, end) of the document that one draw of one
    shard takes; ``place`` orders the draws of a shard.  With ``whole`` a document
    goes with the draws of the block its first word lies in, and only whole
    documents are taken: targets are met to within the documents at the edges.
    ``carry`` names a further column to keep (a row key).
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    kept = pick(df, id_col, text_col, source_col, *([carry] if carry else []))
    kept = kept.toDF("doc", "words", "source", *(["carried"] if carry else []))
    order = F.xxhash64(F.lit(seed), "doc", "words")
    sized = kept.select("doc", "source", *(["carried"] if carry else []), word_count(F.col("words")).alias("size"), order.alias("h"), F.spark_partition_id().alias("part"))
    sized = materialize(sized, "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    ordered = sorted(((r.source, int(r.n)) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    made = plan(ordered, seed, shards, share, most, weights, block)
    names = [x.split()[0] for x in SOURCES.split(", ")]
    sources = spark.createDataFrame([tuple(m[k] for k in names) for m in made], SOURCES).withColumnRenamed("source", "s")

    same = lambda a, b: a.eqNullSafe(b)
    # the place of each document in its source's sequence of words
    bucket = F.pmod("h", F.greatest(F.lit(1), F.ceil(F.col("source_size") / BUCKET_WORDS)))
    placed = _spread(sized).join(sources.select("s", "source_size"), same(F.col("source"), F.col("s"))).drop("s").withColumn("bucket", bucket)
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(placed.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))), "places")
    by_bucket = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_bucket.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = placed.join(bases, same(F.col("source"), F.col("s2")) & (F.col("bucket") == F.col("b2"))).drop("s2", "b2", "source_size")
    full = placed.join(sources, same(F.col("source"), F.col("s"))).withColumn("start", F.col("base") + F.col("at"))

    # the draws that meet a document: for each block it overlaps, every full pass, and the further pass up to the quota
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))

    def pieces_of(b, at):
        lo = F.greatest(b * F.col("block"), F.col("start"))
        hi = F.col("start") + F.col("size") if whole else F.least((b + 1) * F.col("block"), F.col("start") + F.col("size"))

        def draw(p, end):
            number = F.col("n_blocks") * p + at
            # the shard whose run of this source's draws holds the draw
            shard = F.size(F.filter("upto", lambda u: u <= number))
            place = F.xxhash64(F.lit(seed), shard, F.col("number"), number)
            return F.struct(shard.alias("shard"), p.cast("int").alias("draw"), place.alias("place"), (lo - F.col("start")).alias("start"), (end - F.col("start")).alias("end"))

        passes = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda p: draw(p, hi)))
        cut = b * F.col("block") + F.col("part")
        in_part = F.when(lo < cut, hi) if whole else F.least(hi, cut)
        end = F.when(at < F.col("full"), hi).when(at == F.col("full"), in_part)
        more = F.when(end > lo, F.array(draw(F.col("passes"), end)))
        none = F.array().cast(PIECE)
        return F.concat(F.coalesce(passes, none), F.coalesce(more, none))

    met = F.transform(F.sequence(first, first if whole else last), lambda b: F.struct(b.alias("b"), position_of(b, F.col("n_blocks"), seed, F.col("number")).alias("at")))
    pieces = F.when(F.col("size") > 0, F.flatten(F.transform(met, lambda x: pieces_of(x["b"], x["at"])))).otherwise(F.array().cast(PIECE))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p.end - p.start)
    return full.withColumn("pieces", pieces).select(
        F.col("doc").cast(id_type).alias(id_col), "size", "source_size", "target", taken.alias("taken"), "pieces", *([F.col("carried").alias(carry)] if carry else [])
    )


def digests(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns, and the draws behind ``taken``: shard:pass:start-end (words of the document), in the order of shards and draws."""
    one = lambda p: F.concat(p.shard, F.lit(":"), p.draw, F.lit(":"), p.start, F.lit("-"), p.end)
    draws = F.array_join(F.transform(F.array_sort("pieces"), one), ",")
    return mixed.select(F.col(f"`{id_col}`"), "size", "source_size", "target", "taken", draws.alias("draws"))


def draw_documents(df: DataFrame, seed: int = 20, shards: int = 16, text_col: str = "text", **options) -> DataFrame:
    """The mix as documents, in the columns of ``df``: one row per document and draw of the whole document.

    Rows are laid out by shard and shuffled within it by the draws' places.
    Documents without words are kept once: they weigh nothing. The texts follow
    by a join on a row key.
    """
    places = {c: f"c{k}" for k, c in enumerate(df.columns)}
    names = {"id_col": "doc_id", "source_col": "source"} | {k: v for k, v in options.items() if k in ("id_col", "source_col")}
    rest = {k: v for k, v in options.items() if k not in names}
    keyed = with_row_key(df, list(places.values()), "mix-rows")
    mixed = mix(keyed, seed, shards, text_col=places[text_col], carry="row", whole=True, **{k: places[v] for k, v in names.items()}, **rest)
    drawn = mixed.select("row", "size", F.explode_outer("pieces").alias("p")).where("p is not null or size = 0")
    drawn = drawn.select("row", F.coalesce("p.shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).alias("shard"), F.coalesce("p.place", F.xxhash64(F.lit(seed), "row")).alias("place"))
    laid = keyed.join(drawn, "row").repartition(F.col("shard"), F.pmod("place", F.lit(64)))
    return laid.sortWithinPartitions("shard", "place", "row").select(*places.values()).toDF(*df.columns)
