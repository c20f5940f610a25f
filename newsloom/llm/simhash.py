"""Operator 6: SimHash near-dedup through a byte-position inverted index.

Fingerprint: XXH64 (seed 42) of every shingle of ``width`` words, repeats
included; a bit is one if it is set in over half of the hashes.

Links: fingerprints within ``max_bits`` differing bits agree in at least
8 - max_bits of their 8 positional bytes, the guaranteed minimum.  Postings of
single bytes are 2,048 whatever the corpus and each grows with it, so the index
is keyed by sets of that many positions with their bytes (28 keys of 48 bits at
two bits): rows that meet have the minimum, and no other pair can link.  What is
left of a fingerprint under a key is ``max_bits`` bytes, so a posting holds at
most 65,536 of them at two bits, however large the corpus or its largest group.
Inside a posting, the positional bytes that a pair shares are tallied, pairs that
reach the minimum are retained, and their Hamming distance is verified; in large
postings pairs are found by flipping up to ``max_bits`` bits (137 look-ups), not
by comparing all.  One edge per member of a connected part goes out: no posting
emits its pairs.

Equal fingerprints are one node from the start, so copies cost one row each, and
their rows meet their component by a join that spreads hot fingerprints.

Defined cases: a text without words, or null, has fingerprint zero and links
like any other; fewer words than the width give one shingle of them all;
repeated rows each give a row; the component of a fingerprint is the smallest
non-null doc_id it reaches (null if there is none); an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.components import connected, join_hot

from .common import materialize, pick, slices, utf8_buffer

#: The hash seed, and A-Z to a-z.
SEED = 42
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Hashes turned into bits at once.
HASHES = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text (UTF-8), repeats included; fewer words than the width give one, no words none."""
    from xxhash import xxh64_intdigest

    words = text.translate(FOLD).split()  # cuts at the six bytes of ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    return np.array([xxh64_intdigest(x, SEED) for x in parts], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def votes(texts: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each text's hashes: bits that are set in over half of them."""
    out, lo = np.zeros(len(texts), np.uint64), 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= HASHES):
            n += len(texts[hi])
            hi += 1
        own = [k for k in range(lo, hi) if len(texts[k])]
        if n > HASHES:  # a very long text: votes are summed in blocks
            ones = sum(_ones(texts[lo][k : k + HASHES]).sum(axis=0, dtype=np.int64) for k in range(0, n, HASHES))
            out[lo] = np.packbits(ones * 2 > n).view(">u8")[0]
        elif own:
            sizes = np.array([len(texts[k]) for k in own])
            ones = np.add.reduceat(_ones(np.concatenate([texts[k] for k in own])), np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
            out[own] = np.packbits(ones * 2 > sizes[:, None], axis=1).view(">u8").ravel()
        lo = hi
    return out


def fingerprints(parts: list[bytes], width: int) -> np.ndarray:
    """uint64 for each text (UTF-8)."""
    return votes([shingle_hashes(x, width) for x in parts])


def fingerprint(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row's whole text."""
    kept = pick(df, id_col, text_col)
    id_type = kept.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                raw, at = utf8_buffer(part.column(1))
                data = raw.tobytes()
                fps = fingerprints([data[a:b] for a, b in zip(at[:-1], at[1:])], width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return kept.mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of up to ``most`` of ``bits`` bits, the empty one first."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(bits), k)], np.uint64)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the 8 positional bytes agree."""
    differ = a ^ b
    return sum(((differ >> np.uint64(8 * k)) & np.uint64(0xFF)) == 0 for k in range(8))


def posting_edges(full: np.ndarray, rest: np.ndarray, max_bits: int) -> np.ndarray:
    """For the fingerprints under one key, by ascending remainders: index of the first member of each one's connected part."""
    n = len(full)
    label = np.arange(n)
    if n <= 64:
        src, dst = np.triu_indices(n, 1)
    else:
        src, dst = [], []
        for mask in _flips(8 * max_bits, max_bits)[1:]:
            at = np.searchsorted(rest, rest ^ mask)
            hit = np.flatnonzero((at < n) & (rest[np.minimum(at, n - 1)] == rest ^ mask))
            src.append(hit)
            dst.append(at[hit])
        src, dst = np.concatenate(src), np.concatenate(dst)
    kept = np.flatnonzero(shared_bytes(full[src], full[dst]) >= 8 - max_bits)  # the count filter
    kept = kept[np.bitwise_count(full[src[kept]] ^ full[dst[kept]]) <= max_bits]  # and the check
    src, dst = np.concatenate([src[kept], dst[kept]]), np.concatenate([dst[kept], src[kept]])
    while True:
        low = label.copy()
        np.minimum.at(low, src, label[dst])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def fingerprint_edges(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b) with a < b in the order of unsigned remainders: edges that connect exactly the fingerprints linked by chains of ``max_bits`` or fewer bits. ``nodes``: distinct fp."""
    most = 8 - max_bits
    position_sets = list(itertools.combinations(range(8), most))
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in position_sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("set"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for k, m in enumerate(signed)])).alias("key"),
    ).select("fp", "key.set", "key.bytes")
    postings = keyed.groupBy("set", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("set", "fps")

    def run(batches):
        for batch in batches:
            a, b = [], []
            for which, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = np.array(fps, np.int64).view(np.uint64)
                left = [p for p in range(8) if p not in position_sets[which]]
                rest = np.zeros(len(full), np.uint64)
                for k, p in enumerate(left):
                    rest |= (full >> np.uint64(8 * p) & np.uint64(0xFF)) << np.uint64(8 * k)
                order = np.argsort(rest)
                full = full[order]
                low = posting_edges(full, rest[order], max_bits)
                moved = np.flatnonzero(low != np.arange(len(low)))
                a.append(full[low[moved]])
                b.append(full[moved])
            found = [np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return postings.mapInArrow(run, "a long, b long")


def dedup(df: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id): one row per input row."""
    fps = materialize(fingerprint(df, width, id_col, text_col).toDF("doc", "fp"), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    roots = materialize(connected(fingerprint_edges(nodes.select("fp"), max_bits)), "roots")
    linked = nodes.join(roots, nodes.fp == roots.node)
    ids = materialize(linked.groupBy("root").agg(F.min("first").alias("lowest"), F.count("*").alias("n")), "groups")
    # fingerprints that link to another one are the exception: the rest is its own component
    moved = join_hot(roots, ids, "root", "n", total).select(F.col("node").alias("fp"), "lowest")
    named = materialize(nodes.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"), "n"), "named")
    return join_hot(fps, named, "fp", "n", total).select(F.col("doc").alias(id_col), "fp", "component_id")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(F.col(f"`{id_col}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
