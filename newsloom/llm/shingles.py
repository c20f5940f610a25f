"""SimHash near-dedup by similarity: near copies at a Jaccard of ``LEAST`` or more, for the pipeline.

Two texts link if the sets of their shingles of ``width`` words (the words of
operator 6, A-Z folded) have a Jaccard of ``LEAST`` or more.  Every link is
verified on whole texts; no link is lost.  Operator 6's index goes first: nodes
whose fingerprints (of these shingles) are equal or within ``BITS`` bits are
candidates.  At a Jaccard of .8 fingerprints differ in 3 to 11 bits and more,
and beyond seven bits not even one positional byte need be shared, so the rest is
found by prefixes, which is exact: each text's shingles stand in one order common
to all texts, and texts that link share one of the first n - ceil(LEAST n) + 1.
The order is by hash, after it come the shingles that are frequent in a sample
(any order is right; this one keeps lines that many texts hold out of the
prefixes).  Shingles are compared by 62 bits of XXH64.

A group of k near copies does not cost k * k / 2 pairs.  Rounds of stars come
first: in the postings of the prefixes each node meets one other node, one that has
few edits, each node's best one is verified, and components grow.  Only
then do all nodes of a posting that are still in different components meet;
what 512 parity bits of the two sets leave possible, and then what is shared up to
the earlier end of the two prefixes with all of that text's other shingles, bound
the overlap from above, and what passes is verified.  Texts of equal sets are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.components import connected, join_hot
from newsloom.sources.tables import scratch

from .common import materialize, pick, shared_dir, slices, utf8_buffer
from .simhash import fingerprint_edges, shingle_hashes, votes

#: The least Jaccard of a link, as a fraction.
LEAST = (4, 5)

#: Texts in which frequent shingles are looked for, in how many of them one is frequent, and how many go after the others.
SAMPLE, OFTEN, FREQUENT = 20_000, 5, 1 << 16

#: A frequent shingle's place in the order: above all hashes.
LATE = np.uint64(1 << 62)

#: Differing bits up to which operator 6's index gives candidates, rounds of stars, and candidates' ids that are broadcast at most.
BITS, STARS, BROADCAST_IDS = 2, 1, 1 << 20

#: Words of 64 bits in a set's parity bits.
PARITY = 8

#: Pairs sent at once.
PAIRS = 1 << 18


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """62-bit hashes of the text's distinct shingles, ascending."""
    return np.unique(shingle_hashes(text, width) >> np.uint64(2))


def parity_bits(found: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY classes of hashes, whether the set has an odd number of them: two sets differ in at least as many shingles as bits."""
    place = (found >> np.uint64(7)) % np.uint64(64 * PARITY)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=64 * PARITY) & 1, bitorder="little").view(np.int64)


def prefix_length(n: int) -> int:
    """How many of a text's n shingles a linked text must share one of."""
    return n - -(-LEAST[0] * n // LEAST[1]) + 1 if n else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _byte_texts(column: pa.Array) -> list[bytes]:
    raw, at = utf8_buffer(column)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(at[:-1], at[1:])]


def _frequent(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles that are in many texts of a sample, ascending."""
    step = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = [shingle_set(x, width) for x in _byte_texts(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["token"])

    counts = sample.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= OFTEN)
    top = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    return np.sort(np.array([r.token for r in top], np.uint64))


def _sketches(rows: DataFrame, width: int, frequent: np.ndarray) -> DataFrame:
    """(row, fingerprint, digest of the set, n, tokens of the prefix in order, parity bits)."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes = [shingle_hashes(x, width) for x in _byte_texts(part.column(1))]
                digest, n, prefix, parity = [], [], [], []
                for found in hashes:
                    found = np.unique(found >> np.uint64(2))
                    late = np.isin(found, frequent, assume_unique=True)
                    digest.append(xxh3_128_digest(found.tobytes()))
                    n.append(len(found))
                    parity.append(parity_bits(found))
                    ordered = np.concatenate([found[~late], found[late] | LATE])
                    prefix.append(ordered[: prefix_length(len(found))].view(np.int64))
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * PARITY), pa.array(np.concatenate(parity)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(votes(hashes).view(np.int64)), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), tokens, bits], names=["row", "fp", "digest", "n", "tokens", "parity"])

    return rows.mapInArrow(run, "row long, fp long, digest binary, n int, tokens array<long>, parity array<long>")


def _postings(df: DataFrame, names: tuple[str, ...], work, schema: str) -> DataFrame:
    """``work`` (arrays of columns ``names``, whole postings of tokens in order of token, n and row) of each partition, batch by batch; a posting is in one partition."""
    placed = df.select(*names).repartition("token").sortWithinPartitions("token", "n", "row")

    def run(batches):
        left = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            now = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, x in enumerate(left)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last token may go on in the next batch
            if cut:
                yield from work(*[x[:cut] for x in now])
            left = [x[cut:] for x in now]
        if len(left[0]):
            yield from work(*left)

    return placed.mapInArrow(run, schema)


def _shared_entries(nodes: DataFrame) -> DataFrame:
    """(token, row, n, worth) of the prefix tokens that more than one node has; worth is the share, in thousandths, of the node's prefix that they are. What an edit makes is shared with no one, so of a group of near copies those with few edits are worth the most."""

    def work(token, row, n, p):
        apart = token[1:] != token[:-1]
        alone = np.concatenate([[True], apart]) & np.concatenate([apart, [True]])
        yield pa.RecordBatch.from_arrays([pa.array(x[~alone]) for x in (token, row, n, p)], names=["token", "row", "n", "p"])

    spread = nodes.select("row", "n", F.size("tokens").alias("p"), F.explode("tokens").alias("token"))
    shared = materialize(_postings(spread, ("token", "row", "n", "p"), work, "token long, row long, n long, p long"), "near-entries")
    worth = shared.groupBy("row").agg((F.count("*") * 1000 / F.first("p")).cast("long").alias("worth"))
    return shared.drop("p").join(worth, "row").select("token", "row", "n", "worth")


def star_pairs(token: np.ndarray, row: np.ndarray, n: np.ndarray, label: np.ndarray, worth: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, row): each entry and its posting's pivot, if that is of another component and of a size that allows a link.

    The pivot is the entry that is worth the most; in later turns one of those worth nearly as much, by a hash of the row and the turn.
    """
    if not len(token):
        return row, row
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    rank = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(token))))
    if turn:
        near = 10 * worth >= 9 * np.maximum.reduceat(worth, begin)[rank]
        with np.errstate(over="ignore"):
            mixed = (row.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        worth = np.where(near, (mixed >> np.uint64(33)).astype(np.int64) + 1, 0)
    order = np.lexsort((row, -worth, rank))
    pivot = order[begin][rank]
    able = (label[pivot] != label) & (LEAST[0] * np.maximum(n, n[pivot]) <= LEAST[1] * np.minimum(n, n[pivot]))
    return row[pivot[able]], row[able]


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, smaller row first, and how often each occurs."""
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    at = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[at, 0], pairs[at, 1], np.diff(np.append(at, len(pairs)))


def able_to_link(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sizes and the parity bits of two entries leave a link possible."""
    both = n[i] + n[j]
    least = -(-LEAST[0] * both // sum(LEAST))  # what the sets share at least, if they link
    apart = np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return (LEAST[0] * np.maximum(n[i], n[j]) <= LEAST[1] * np.minimum(n[i], n[j])) & (apart <= both - 2 * least)


def mixed_entries(token: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which entries stand in postings of more than one component."""
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    mixed = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)
    return np.repeat(mixed, np.diff(np.append(begin, len(token))))


def cross_pairs(token: np.ndarray, row: np.ndarray, n: np.ndarray, label: np.ndarray, bits: np.ndarray):
    """(a, b, shared) for rows of different components that stand under one token and may link; entries are in order of token and n.

    In a posting, rows outside its largest component meet the others. Pairs come
    in parts: sums over all are the shared tokens.
    """
    if not len(token):
        return
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    end = np.append(begin[1:], len(token))
    # postings of two, at once
    i = begin[end - begin == 2]
    i = i[label[i] != label[i + 1]]
    i = i[able_to_link(n, bits, i, i + 1)]
    a, b, held = [row[i]], [row[i + 1]], len(i)
    for lo, hi in zip(begin[end - begin > 2], end[end - begin > 2]):
        values, where, times = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
        if len(values) == 1:
            continue
        others = where != int(np.argmax(times))
        for k in np.flatnonzero(others):
            first = int(np.searchsorted(n[lo:hi], -(-LEAST[0] * n[lo + k] // LEAST[1])))
            last = int(np.searchsorted(n[lo:hi], LEAST[1] * n[lo + k] // LEAST[0], "right"))
            met = np.arange(first, last)
            met = met[(where[met] != where[k]) & (~others[met] | (met > k))]
            met = met[able_to_link(n, bits, np.full(len(met), lo + k), lo + met)]
            a.append(np.full(len(met), row[lo + k]))
            b.append(row[lo + met])
            held += len(met)
            if held > PAIRS:
                yield _counted(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
    if held:
        yield _counted(np.concatenate(a), np.concatenate(b))


def _labelled(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("label", F.col("row"))
    return entries.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("label", F.coalesce("root", "row"))


def _star_round(entries: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """(a, b): each node with the pivot it shares the most tokens with."""

    def work(token, row, n, label, worth):
        pivot, own = star_pairs(token, row, n, label, worth, turn)
        if len(own):
            order = np.lexsort((own, pivot))
            pivot, own = pivot[order], own[order]
            at = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (own[1:] != own[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(pivot[at]), pa.array(own[at]), pa.array(np.diff(np.append(at, len(own))))], names=["a", "b", "shared"])

    met = _postings(_labelled(entries, roots), ("token", "row", "n", "label", "worth"), work, "a long, b long, shared long")
    met = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    return met.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")


def _closing_pairs(entries: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes of different components whose prefixes allow a link."""
    names = ("token", "row", "n", "label")

    def mixed(*columns):
        keep = mixed_entries(columns[0], columns[3])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=names)

    def work(token, row, n, label, *bits):
        for a, b, shared in cross_pairs(token, row, n, label, np.stack(bits, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared.astype(np.int64))], names=["a", "b", "shared"])

    apart = materialize(_postings(_labelled(entries, roots), names, mixed, "token long, row long, n long, label long"), "near-mixed")
    places = [f"p{k}" for k in range(PARITY)]
    apart = apart.join(nodes.select("row", *[F.get("parity", F.lit(k)).alias(p) for k, p in enumerate(places)]), "row")
    met = _postings(apart, (*names, *places), work, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    sizes = nodes.select("row", "n", F.size("tokens").alias("p"), F.element_at("tokens", -1).alias("end"))
    side = lambda k: sizes.toDF(k, f"n{k}", f"p{k}", f"end{k}")
    rest = F.when(F.col("enda") <= F.col("endb"), F.col("na") - F.col("pa")).otherwise(F.col("nb") - F.col("pb"))
    able = (F.col("shared") + rest) * sum(LEAST) >= (F.col("na") + F.col("nb")) * LEAST[0]
    return met.join(side("a"), "a").join(side("b"), "b").where(able).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The pairs whose whole texts link. Only the texts of candidates move: their ids are broadcast where they are few, else joined."""
    pairs = materialize(pairs, "near-pairs")
    few = 2 * pairs.count() <= BROADCAST_IDS
    ids = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    own = rows.join(F.broadcast(ids) if few else ids, "row", "left_semi")
    wide = pairs.join(own.toDF("a", "ta"), "a").join(own.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ta", 1 << 20):
                keep = [linked(shingle_set(x, width), shingle_set(y, width)) for x, y in zip(_byte_texts(part.column(2)), _byte_texts(part.column(3)))]
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(wide.mapInArrow(run, "a long, b long"), "near-links")


def _similar_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b): each node and the first of its fingerprint; of fingerprints that operator 6's index links, the first nodes."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("row").alias("a"), F.count("*").alias("times")), "near-fingerprints")
    total = firsts.agg(F.sum("times")).first()[0] or 0
    same = join_hot(nodes.select("fp", F.col("row").alias("b")), firsts, "fp", "times", total).where("a <> b").select("a", "b")
    edges = fingerprint_edges(firsts.select("fp"), BITS).toDF("fa", "fb")
    of = lambda k: firsts.select(F.col("fp").alias(f"f{k}"), F.col("a").alias(k))
    near = edges.join(of("a"), "fa").join(of("b"), "fb").select("a", "b")
    return same.unionByName(near)


def near_components(nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, root) of all nodes (row, fp, n, tokens) that link to another; ``rows`` (row, text) has their texts."""
    entries = materialize(_shared_entries(nodes), "near-entries")
    first = _similar_fingerprints(nodes).unionByName(_star_round(entries, None, 0)).distinct()
    links = _verified(first, rows, width)
    for turn in range(1, STARS):
        roots = materialize(connected(links, "near-components"), "near-roots")
        links = links.unionByName(_verified(_star_round(entries, roots, turn), rows, width))
    roots = materialize(connected(links, "near-components"), "near-roots")
    closing = _verified(_closing_pairs(entries, nodes, roots), rows, width)
    return connected(links.unionByName(closing), "near-components")


def keep_one(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component of links the row with the smallest id stays (rows without an id come last, repeated rows and texts without words count as copies)."""
    places = {c: f"c{k}" for k, c in enumerate(df.columns)}
    keyed = materialize(df.toDF(*places.values()).withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    rows = pick(keyed, "row", places[text_col]).toDF("row", "text")
    ids = pick(keyed, "row", places[id_col]).toDF("row", "id").select("row", F.struct(F.col("id").isNull().alias("absent"), "id", "row").alias("order"))
    path = shared_dir(df.sparkSession, "near-kept")
    with scratch(df.sparkSession):  # but for the rows that stay, all that is written on the way goes
        sketches = materialize(_sketches(rows, width, _frequent(rows, width)), "sketches")
        firsts = sketches.select("row", "digest").join(ids, "row").groupBy("digest").agg(F.min("order").alias("first"))
        firsts = materialize(firsts.select("first", F.col("first.row").alias("node")), "nodes")
        nodes = materialize(sketches.join(firsts.select(F.col("node").alias("row")), "row", "left_semi").where("n > 0").drop("digest"), "near-nodes")
        roots = materialize(near_components(nodes, rows, width), "near-groups")
        alone = firsts.join(roots, "node", "left_anti").select(F.col("node").alias("row"))
        lowest = firsts.join(roots, "node").groupBy("root").agg(F.min("first").alias("low")).select(F.col("low.row").alias("row"))
        alone.unionByName(lowest).write.parquet(path)
    kept = df.sparkSession.read.schema("row long").parquet(path)
    return keyed.join(kept, "row", "left_semi").select(*places.values()).toDF(*df.columns)
