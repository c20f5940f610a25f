"""Operator 9: LM scoring by an interpolated modified Kneser-Ney n-gram model.

Counting.  Words are hashed to 64 bits (XXH64, seed 42); an n-gram's key is a
hash of its context's and its last word's.  Each task counts the n-grams of the
highest order of about a million tokens and sends, for each shard, one packed
record of words and counts.  Shards go by the word before the last: a shard then
has all of its contexts whole, of every order from the highest down to two, and
counts each distinct n-gram as one occurrence of its last n - 1 words (a
continuation count) on the spot.  Words that a sample of all rows shows to be
heavy (``HEAVY`` at most) do not meet in one task: their n-grams go by the whole
context, and where that is heavy too by the key, and are handed down order by
order.  The sample decides where n-grams meet and never what is counted.  The
texts are read ``WAVES`` times, each time for a part of the shards, so that only
that part of the shuffle is on disk at once.

Files.  A shard writes, for each order, the keys with their counts, the contexts
seen once, and the other contexts with what is known of them (occurrences; words
seen once, twice, more often), as arrays sorted by hash.  Of large arrays the
upper 16 bits of a hash are an index, which saves two bytes of eight.  Blocks are
written by Spark's text sink to the shared folder (the line separator is padding;
blocks keep to 8-byte places) and are memory-mapped by the workers, which share
their pages, when a shard is first asked for.  Where that folder is not a mounted
one, Spark ships the files to the workers.  The driver holds a few totals a shard
and the heavy contexts.

Scoring.  With c the counts of an order, D its discounts (from counts of counts)
and h a context that was seen,
p(w|h) = (max(c(hw) - D, 0) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) p(w|h')) / c(h),
h' being h without its first word; an unseen context leaves p(w|h').  Single words
end in the uniform 1 / (V + 1) that unseen words share.  A text is its words and
an end, after order - 1 begins.  ``order`` is a parameter.

Defined cases: null and empty texts are the end alone; a null doc_id hashes as
the empty text and so trains; repeated rows count each time; with nothing to
learn from every probability is 1; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import gc
import json
import struct
import time
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_fold, pick, shared_dir, slices, utf8_buffer
from .simhash import FOLD, SEED

#: Highest order of n-grams.
ORDER = 3

#: Tokens a task counts before it sends; text bytes of an n-gram shard and of a word shard; rows of the sample (about) and heavy contexts of an order at most.
FLUSH_TOKENS, GRAM_BYTES, WORD_BYTES, SAMPLE_ROWS, HEAVY = 700_000, 8 << 20, 64 << 20, 4000, 1000

#: Passes over the texts, keys of a block that has an index of upper bits at least, and the share of a shard's tokens above which a word of the sample is heavy.
WAVES, INDEXED, HEAVY_SHARE = 3, 1 << 16, 0.25

#: Hashes of what is no word: the empty string ends a text, a space begins it.
END_TOKEN, BEGIN_TOKEN = b"", b" "

BLOCK_HEAD = struct.Struct("<8sQQQQ")
KEY_MAGIC, CONTEXT_MAGIC, ONCE_MAGIC, WORD_MAGIC = b"NLKNKEYS", b"NLKNCTXT", b"NLKNONCE", b"NLKNWORD"
#: What is known of a context, and of a word.
CONTEXT_FIELDS, WORD_FIELDS = 4, 2


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, SEED)


def pair_hash(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = first * np.uint64(0x9E3779B97F4A7C15) + then
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB) + first
    return x ^ x >> np.uint64(31)


def tokens(data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by the end token, and tokens per text."""
    from xxhash import xxh64_intdigest

    data = data.translate(FOLD)  # split() cuts at the six bytes of ASCII white space
    end, hashes, sizes = word_hash(END_TOKEN), [], []
    for a, b in zip(edges[:-1], edges[1:]):
        found = [xxh64_intdigest(w, SEED) for w in data[a:b].split()]
        hashes += found
        hashes.append(end)
        sizes.append(len(found) + 1)
    return np.array(hashes, np.uint64), np.array(sizes, np.int64)


def words_before(hashes: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the word before it, the one before that, and so on; before a text stand begins."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(hashes)) - np.repeat(starts, sizes)
    out = []
    for back in range(1, order):
        word = np.full(len(hashes), np.uint64(word_hash(BEGIN_TOKEN)))
        inside = np.flatnonzero(place >= back)
        word[inside] = hashes[inside - back]
        out.append(word)
    return out


def contexts(before: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the last word before, of the last two, and so on."""
    out, held = [], np.zeros(len(before[0]), np.uint64)
    for word in before:
        held = pair_hash(word, held)
        out.append(held)
    return out


class Layout:
    """Which shard has an n-gram or a context of an order: numbers below ``shards`` are those of words that are not heavy."""

    def __init__(self, shards: int, words: list[int], heavy: dict[int, list[int]]):
        self.shards, self.words = shards, np.array(sorted(words), np.uint64)
        self.heavy = {m: np.array(sorted(h), np.uint64) for m, h in heavy.items()}

    def may_be_in(self, last: np.ndarray, wave: int, waves: int) -> np.ndarray:
        """Places of n-grams by the word before their last: those whose shard is one of a pass, or not known by that word."""
        return np.flatnonzero(np.isin(last, self.words) | ((last >> np.uint64(7)) % np.uint64(self.shards) % np.uint64(waves) == wave))

    def of_contexts(self, level: int, last: np.ndarray, context: np.ndarray) -> np.ndarray:
        n, cut = np.uint64(self.shards), np.uint64(7)
        return np.where(np.isin(last, self.words), n + (context >> cut) % n, (last >> cut) % n)

    def of_grams(self, level: int, last: np.ndarray, context: np.ndarray, key: np.ndarray) -> np.ndarray:
        n = np.uint64(self.shards)
        return np.where(np.isin(last, self.words) & np.isin(context, self.heavy[level]), n + key % n, self.of_contexts(level, last, context))


def _pack_counts(x: np.ndarray) -> bytes:
    """One byte each; 255 refers to a list of large ones."""
    large = x[x >= 255]
    return struct.pack("<Q", len(large)) + np.minimum(x, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes()


def _unpack_counts(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    k = struct.unpack_from("<Q", data, at)[0]
    out = np.frombuffer(data, np.uint8, n, at + 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", k, at + 8 + n).astype(np.int64)
    return out, at + 8 + n + 8 * k


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def distinct(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending keys, where one of each stands, summed counts)."""
    order = np.argsort(key)
    at = _starts(key[order])
    if count is None:
        summed = np.diff(np.append(at, len(key)))
    else:
        summed = np.add.reduceat(count[order], at) if len(at) else np.zeros(0, np.int64)
    return key[order[at]], order[at], summed


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending values, where one of each stands, the place of each entry's value)."""
    order = np.argsort(x)
    held = x[order]
    new = np.ones(len(x), bool)
    new[1:] = held[1:] != held[:-1]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return held[new], order[new], back


def gram_records(shard: np.ndarray, before: list[np.ndarray], word: np.ndarray, count: np.ndarray):
    """(shard, record) of distinct n-grams: the last word before each, in runs, then the others before it, the word, and its count."""
    order = np.lexsort((before[0], shard))
    shard, word, count, before = shard[order], word[order], count[order], [c[order] for c in before]
    at = np.append(_starts(shard), len(shard))
    for lo, hi in zip(at[:-1], at[1:]):
        runs = _starts(before[0][lo:hi])
        sizes = np.diff(np.append(runs, hi - lo))
        rest = b"".join(c[lo:hi].astype("<u8").tobytes() for c in [*before[1:], word])
        yield int(shard[lo]), struct.pack("<QQ", len(runs), hi - lo) + before[0][lo:hi][runs].astype("<u8").tobytes() + _pack_counts(sizes) + rest + _pack_counts(count[lo:hi])


def read_grams(record: bytes, depth: int) -> list[np.ndarray]:
    """The ``depth`` words before each n-gram's last, that word, and its count."""
    n_runs, n = struct.unpack_from("<QQ", record)
    runs = np.frombuffer(record, "<u8", n_runs, 16)
    sizes, at = _unpack_counts(record, n_runs, 16 + 8 * n_runs)
    rest = np.frombuffer(record, "<u8", depth * n, at).reshape(depth, n)
    count, _ = _unpack_counts(record, n, at + 8 * depth * n)
    return [np.repeat(runs, sizes), *rest, count]


def word_record(word: np.ndarray, fields: list[np.ndarray]) -> bytes:
    return struct.pack("<Q", len(word)) + word.astype("<u8").tobytes() + b"".join(_pack_counts(f) for f in fields)


def read_words(record: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<Q", record)[0]
    out, at = [np.frombuffer(record, "<u8", n, 8)], 8 + 8 * n
    for _ in range(WORD_FIELDS):
        field, at = _unpack_counts(record, n, at)
        out.append(field)
    return out


def context_stats(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each context: occurrences, and words seen once, twice, more often."""
    known, where = np.unique(context, return_inverse=True)
    total = np.bincount(where, weights=count, minlength=len(known)).astype(np.int64)  # exact below 2^53
    return known, [total, *(np.bincount(where[m], minlength=len(known)) for m in (count == 1, count == 2, count > 2))]


def counts_of_counts(x: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(x, 5), minlength=6)[1:5].tolist()


def block(magic: bytes, level: int, number: int, key: np.ndarray, fields: list[np.ndarray]) -> bytes:
    """Keys in order (large arrays: where those of each upper 16 bits begin, then 32 and 16 lower bits), then each field as bytes and the places and values of its large ones. Padded so that block and separator end on an 8-byte place."""
    even = lambda x: x + b"\0" * (-len(x) % 8)
    parts = [BLOCK_HEAD.pack(magic, level, number, len(key), len(fields))]
    if len(key) < INDEXED:
        parts.append(key.astype("<u8").tobytes())
    else:
        begins = np.searchsorted(key >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64))
        parts += [even(begins.astype("<u4").tobytes()), even((key >> np.uint64(16)).astype("<u4").tobytes()), even(key.astype("<u2").tobytes())]
    for f in fields:
        large = np.flatnonzero(f >= 255)
        parts += [struct.pack("<Q", len(large)), even(np.minimum(f, 255).astype(np.uint8).tobytes()), large.astype("<u8").tobytes(), f[large].astype("<u8").tobytes()]
    made = b"".join(parts)
    return made + b"\0" * ((7 - len(made)) % 8)


class Table:
    """A memory-mapped block."""

    def __init__(self, mapped: np.ndarray, at: int):
        self.magic, self.level, self.number, self.n, k = BLOCK_HEAD.unpack(mapped[at : at + BLOCK_HEAD.size].tobytes())
        if self.magic not in (KEY_MAGIC, CONTEXT_MAGIC, ONCE_MAGIC, WORD_MAGIC):
            raise ValueError(f"no block at byte {at}")
        self.at = at + BLOCK_HEAD.size

        def take(kind, count):
            size = count * np.dtype(kind).itemsize
            out = mapped[self.at : self.at + size].view(kind)
            self.at += size + -size % 8
            return out

        self.keys = take("<u8", self.n) if self.n < INDEXED else None
        if self.keys is None:
            self.begins, self.middle, self.low = take("<u4", (1 << 16) + 1), take("<u4", self.n), take("<u2", self.n)
        self.fields = []
        for _ in range(k):
            large = int(take("<u8", 1)[0])
            self.fields.append((take("u1", self.n), take("<u8", large), take("<u8", large)))
        self.end = self.at + (7 - self.at) % 8 + 1

    def _places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``wanted`` that are there, their places here)."""
        if self.keys is not None:
            at = np.searchsorted(self.keys, wanted)
            hit = np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == wanted))
            return hit, at[hit]
        upper, lower = (wanted >> np.uint64(48)).astype(np.int64), wanted & np.uint64((1 << 48) - 1)
        lo, end = self.begins[upper].astype(np.int64), self.begins[upper + 1].astype(np.int64)
        value = lambda i: (self.middle[i].astype(np.uint64) << np.uint64(16) | self.low[i]) & np.uint64((1 << 48) - 1)
        hi = end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = value(mid) < lower[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        hit = np.flatnonzero(lo < end)
        hit = hit[value(lo[hit]) == lower[hit]]
        return hit, lo[hit]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(places in ``wanted`` that are there, their fields)."""
        if not self.n:
            return np.zeros(0, np.int64), [np.zeros(0, np.int64)] * len(self.fields)
        hit, at = self._places(wanted)
        out = []
        for small, where, value in self.fields:
            found = small[at].astype(np.int64)
            big = np.flatnonzero(found == 255)
            if len(big):
                found[big] = value[np.searchsorted(where, at[big].astype(np.uint64))]
            out.append(found)
        return hit, out


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from counts of counts; where these do not allow it, halves of the count up to 1.5."""
    if not n[0] or not n[1]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    made = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2 for k in range(3)]
    return [min(max(d, 0.0), float(k + 1)) for k, d in enumerate(made)]


def _discount(count: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


class Model:
    """Looks n-grams up in the files that hold them, each mapped when it is first needed."""

    def __init__(self, spec: dict):
        self.spec, self.tables, self.read = spec, {}, set()
        known = {int(m): sorted((int(k), x) for k, x in h.items()) for m, h in spec["heavy"].items()}
        self.heavy = {m: (np.array([k for k, _ in h], np.uint64), np.array([x for _, x in h], np.int64).reshape(-1, CONTEXT_FIELDS)) for m, h in known.items()}
        self.layout = Layout(spec["shards"], spec["heavy_words"], {int(m): h for m, h in spec["heavy_contexts"].items()})

    def _table(self, magic: bytes, level: int, number: int) -> Table | None:
        for place in self.spec["files"].get(f"{level}/{number}", ()):
            if place not in self.read:
                self.read.add(place)
                mapped, at = np.asarray(np.memmap(_local(place), np.uint8, "r")), 0
                while at < len(mapped):
                    made = Table(mapped, at)
                    self.tables[made.magic, made.level, made.number], at = made, made.end
        return self.tables.get((magic, level, number))

    @staticmethod
    def _each(route: np.ndarray):
        """(number, its places): sorted by few bits where numbers are small."""
        small = route.astype(np.uint16) if len(route) and int(route.max()) < 1 << 16 else route
        order = np.argsort(small, kind="stable")
        at = np.append(_starts(route[order]), len(order))
        for lo, hi in zip(at[:-1], at[1:]):
            yield int(route[order[lo]]), order[lo:hi]

    def _fields(self, magic: bytes, level: int, wanted: np.ndarray, route: np.ndarray, fields: int) -> list[np.ndarray]:
        """Of keys; zeros where there is nothing."""
        out = [np.zeros(len(wanted), np.int64) for _ in range(fields)]
        for number, own in self._each(route):
            table = self._table(magic, level, number)
            if table is not None:
                hit, found = table.find(wanted[own])
                for to, x in zip(out, found):
                    to[own[hit]] = x
        return out

    def _once(self, level: int, wanted: np.ndarray, route: np.ndarray) -> np.ndarray:
        """Which contexts were seen once."""
        out = np.zeros(len(wanted), bool)
        for number, own in self._each(route):
            table = self._table(ONCE_MAGIC, level, number)
            if table is not None:
                out[own[table.find(wanted[own])[0]]] = True
        return out

    def score(self, hashes: np.ndarray, sizes: np.ndarray):
        """(known tokens, base score, score) of each text."""
        s, uniform = self.spec, 1.0 / (self.spec["V"] + 1)
        words, _, where = _unique(hashes)
        c, cont = self._fields(WORD_MAGIC, 1, words, words % np.uint64(s["word_shards"]), WORD_FIELDS)
        base = np.log10((c + 0.5) / (s["N"] + 0.5 * (s["V"] + 1)))
        e, m, pairs = s["D"]["1"], s["m"], max(s["pairs"], 1)
        spare = (e[0] * m[0] + e[1] * m[1] + e[2] * m[2]) / pairs if s["pairs"] else 1.0
        p = (np.maximum(cont - _discount(cont, e), 0) / pairs + spare * uniform)[where]
        before = words_before(hashes, sizes, s["order"])
        for level, context in enumerate(contexts(before), 2):
            d, (heavy, stats) = s["D"][str(level)], self.heavy[level]
            # most n-grams of a slice are distinct, its contexts less so
            key = pair_hash(context, hashes)
            (count,) = self._fields(KEY_MAGIC, level, key, self.layout.of_grams(level, before[0], context, key), 1)
            known, first, at = _unique(context)
            route = self.layout.of_contexts(level, before[0][first], known)
            total, *n = self._fields(CONTEXT_MAGIC, level, known, route, CONTEXT_FIELDS)
            rest = np.flatnonzero(total == 0)
            once = self._once(level, known[rest], route[rest])
            total[rest[once]] = n[0][rest[once]] = 1
            if len(heavy):
                place = np.minimum(np.searchsorted(heavy, known), len(heavy) - 1)
                own = heavy[place] == known
                total[own] = stats[place[own], 0]
                for k in range(3):
                    n[k][own] = stats[place[own], k + 1]
            held = (d[0] * n[0] + d[1] * n[1] + d[2] * n[2])[at]
            total = total[at]
            p = np.where(total > 0, (np.maximum(count - _discount(count, d), 0) + held * p) / np.maximum(total, 1), p)
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts)
        return add((c > 0)[where].astype(np.int64)), add(base[where]), add(np.log10(p))


_MODELS: dict[str, Model] = {}


def _local(place: str) -> str:
    parsed = urlparse(place)
    if parsed.scheme in ("", "file"):
        return unquote(parsed.path)
    from pyspark import SparkFiles

    return SparkFiles.get(place.rpartition("/")[2])


def _model(spec: dict) -> Model:
    if spec["path"] not in _MODELS:
        _MODELS.clear()
        _MODELS[spec["path"]] = Model(spec)
    return _MODELS[spec["path"]]


def heavy_ones(kept: DataFrame, order: int, shards: int) -> tuple[list[int], dict[int, list[int]]]:
    """(words, contexts of each order) that would fill a shard (a context is spread if its last word is heavy too), by about ``SAMPLE_ROWS`` rows that hashes of the texts pick from all."""
    sample = kept.where(F.pmod(F.xxhash64("text"), F.lit(max(1, kept.count() // SAMPLE_ROWS))) == 0)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, at = utf8_buffer(part.column(0))
                hashes, sizes = tokens(raw.tobytes(), at)
                before = words_before(hashes, sizes, order)
                for level, context in enumerate([before[0], *contexts(before)], 1):
                    known, times = np.unique(context, return_counts=True)
                    top = np.argsort(-times, kind="stable")[: 2 * HEAVY]
                    share = np.append(times[top], len(hashes))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top) + 1, level, np.int32)), pa.array([*known[top].view(np.int64).tolist(), None], pa.int64()), pa.array(share)], names=["level", "context", "n"])

    counts = sample.mapInArrow(run, "level int, context long, n long").groupBy("level", "context").agg(F.sum("n").alias("n"))
    # of each order the most frequent ones, and the number of all tokens
    best = F.row_number().over(Window.partitionBy("level").orderBy(F.col("context").isNull().desc(), F.desc("n"), "context"))
    rows = counts.withColumn("place", best).where(F.col("place") <= HEAVY + 1).collect()
    total = max([1, *(r.n for r in rows if r.context is None)])
    large = {m: sorted(r.context % (1 << 64) for r in rows if r.level == m and r.context is not None and r.n * shards > HEAVY_SHARE * total) for m in range(1, order + 1)}
    words = large.pop(1)
    # the contexts of order two are the heavy words themselves
    large[2] = sorted(pair_hash(np.array(words, np.uint64), np.zeros(len(words), np.uint64)).tolist())
    return words, large


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> dict:
    """Count all texts; returns where the model lies and its totals."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    kept = pick(docs, text_col).toDF("text")
    volume = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, word_shards = max(1, -(-volume // GRAM_BYTES)), max(1, -(-volume // WORD_BYTES))
    heavy_words, heavy = heavy_ones(kept, order, shards)
    path = shared_dir(spark, "lm")

    def count(wave: int):
        def run(batches):
            layout, held, n = Layout(shards, heavy_words, heavy), [], 0

            def send():
                shard, key, word, *before = (np.concatenate(x) for x in zip(*held))
                held.clear()
                _, first, times = distinct(key)
                rows = list(gram_records(shard[first], [c[first] for c in before], word[first], times))
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "record"])

            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    raw, at = utf8_buffer(part.column(0))
                    hashes, sizes = tokens(raw.tobytes(), at)
                    before = words_before(hashes, sizes, order)
                    # of words that are not heavy the last alone tells the shard: only those of this pass are looked at
                    able = layout.may_be_in(before[0], wave, WAVES)
                    before, word = [b[able] for b in before], hashes[able]
                    context = contexts(before)[-1]
                    key = pair_hash(context, word)
                    shard = layout.of_grams(order, before[0], context, key)
                    own = np.flatnonzero(shard % np.uint64(WAVES) == wave)
                    held.append([x[own] for x in (shard, key, word, *before)])
                    n += len(own)
                    if n >= FLUSH_TOKENS:
                        yield send()
                        n = 0
            if n:
                yield send()

        return run

    def add_grams(level: int):
        def tables(at: int, number: int, before: list[np.ndarray], word: np.ndarray, times: np.ndarray | None, spread: np.ndarray):
            """The model's blocks of one order, its totals, and one of each distinct n-gram."""
            context = contexts(before)[-1]
            grams, first, times = distinct(pair_hash(context, word), times)
            known, stats = context_stats(context[first], times)
            hot = np.isin(known, spread)
            once = ~hot & (stats[0] == 1)
            many = ~hot & ~once
            blocks = [block(KEY_MAGIC, at, number, grams, [times]), block(CONTEXT_MAGIC, at, number, known[many], [x[many] for x in stats]), block(ONCE_MAGIC, at, number, known[once], [])]
            total = {"level": at, "grams": len(grams), "n": counts_of_counts(times), "hot": [[int(known[i]), *(int(x[i]) for x in stats)] for i in np.flatnonzero(hot)]}
            return [("model", b"\n".join(blocks)), ("total", json.dumps(total).encode())], first, times

        def to_words(words: np.ndarray, fields: list[np.ndarray]):
            """Occurrences of words, and distinct words before them."""
            return [(1, k, word_record(words[own], [f[own] for f in fields])) for k, own in Model._each(words % np.uint64(word_shards)) if len(own)]

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            number, layout = key[0].as_py(), Layout(shards, heavy_words, heavy)
            *before, word, times = (np.concatenate(x) for x in zip(*[read_grams(x, level - 1) for x in table["record"].to_pylist()]))
            out, down = [], []
            spoken = distinct(word, times)[::2] if level == order else (word[:0], times[:0])
            for at in range(level, 1, -1):
                made, first, _ = tables(at, number, before, word, times, layout.heavy[at] if number >= shards else np.zeros(0, np.uint64))
                out += made
                before, word, times = [c[first] for c in before], word[first], None
                if at == 2:
                    known, _, preceding = distinct(word)
                    words, where = np.unique(np.concatenate([spoken[0], known]), return_inverse=True)
                    both = [np.zeros(len(words), np.int64) for _ in range(WORD_FIELDS)]
                    both[0][where[: len(spoken[0])]], both[1][where[len(spoken[0]) :]] = spoken[1], preceding
                    down += to_words(words, both)
                    break
                before.pop()  # each distinct gram is one occurrence of its last words
                if number >= shards:  # heavy words: the order below is added up by shards of its own
                    context = contexts(before)[-1]
                    grams, first, preceding = distinct(pair_hash(context, word))
                    before, word = [c[first] for c in before], word[first]
                    shard = layout.of_grams(at - 1, before[0], context[first], grams)
                    down += [(at - 1, k, r) for k, r in gram_records(shard, before, word, preceding)]
                    down += to_words(spoken[0], [spoken[1], np.zeros(len(spoken[1]), np.int64)])
                    break
            out += [(f"down{to}", struct.pack("<QQ", k, len(r)) + r) for to, k, r in down]
            return pa.table([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], names=["kind", "value"])

        return run

    def write(df: DataFrame, at: str) -> None:
        df.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", "\n").text(at)

    def split_records(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                at, slots, records = 0, [], []
                while at < len(data):
                    slot, size = struct.unpack_from("<QQ", data, at)
                    slots.append(slot)
                    records.append(data[at + 16 : at + 16 + size])
                    at += 16 + size + 1
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(records, pa.binary())], names=["shard", "record"])

    def handed_down(level: int) -> DataFrame | None:
        """Records for an order, from the files of the orders above it."""
        places = [p for f in folders if _files(spark, p := f"{f}/kind=down{level}")]
        return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(places).select("content").mapInArrow(split_records, "shard int, record binary") if places else None

    def add_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, *fields = (np.concatenate(x) for x in zip(*[read_words(x) for x in table["record"].to_pylist()]))
        words, where = np.unique(words, return_inverse=True)
        c, cont = (np.bincount(where, weights=f, minlength=len(words)).astype(np.int64) for f in fields)
        total = {"N": int(c.sum()), "V": len(words), "m": counts_of_counts(cont), "m3": int((cont > 2).sum())}
        out = [("model", block(WORD_MAGIC, 1, key[0].as_py(), words, [c, cont])), ("total", json.dumps(total).encode())]
        return pa.table([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], names=["kind", "value"])

    spec = {"path": path, "order": order, "heavy_words": heavy_words, "heavy_contexts": heavy, "heavy": {m: {} for m in range(2, order + 1)}, "shards": shards, "word_shards": word_shards, "files": {}}
    spec |= {"N": 0, "V": 0, "pairs": 0, "m": [0, 0, 0], "D": {str(m): [0.5, 1.0, 1.5] for m in range(1, order + 1)}}
    if not kept.limit(1).count():
        return spec
    folders = []
    for wave in range(WAVES):
        placed = kept.mapInArrow(count(wave), "shard int, record binary").repartition(max(1, -(-2 * shards // WAVES)), "shard")
        folders.append(f"{path}/{order}-{wave}")
        write(placed.groupBy("shard").applyInArrow(add_grams(order), "kind string, value binary"), folders[-1])
        # what a wave has shuffled is held until the driver's garbage is collected, in two steps: the plan, then its shuffle
        del placed
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(1)
    for level in range(order - 1, 1, -1):
        below = handed_down(level)
        if below is not None:
            write(below.repartition(shards, "shard").groupBy("shard").applyInArrow(add_grams(level), "kind string, value binary"), f"{path}/{level}-0")
            folders.append(f"{path}/{level}-0")
    n = {m: [0] * 4 for m in range(2, order + 1)}
    # a line a shard and order
    for t in (json.loads(r.value) for f in folders if _files(spark, f"{f}/kind=total") for r in spark.read.text(f"{f}/kind=total").toLocalIterator()):
        level = t["level"]
        n[level] = [a + b for a, b in zip(n[level], t["n"])]
        if level == 2:
            spec["pairs"] += t["grams"]
        for k, *stats in t["hot"]:
            spec["heavy"][level][str(k)] = [a + b for a, b in zip(spec["heavy"][level].get(str(k), [0] * CONTEXT_FIELDS), stats)]
    spec["D"] |= {str(m): discounts(x) for m, x in n.items()}
    write(handed_down(1).repartition(word_shards, "shard").groupBy("shard").applyInArrow(add_words, "kind string, value binary"), f"{path}/1-0")
    m4 = [0] * 4
    for t in (json.loads(r.value) for r in spark.read.text(f"{path}/1-0/kind=total").toLocalIterator()):
        spec["N"] += t["N"]
        spec["V"] += t["V"]
        spec["m"] = [a + b for a, b in zip(spec["m"], [*t["m"][:2], t["m3"]])]
        m4 = [a + b for a, b in zip(m4, t["m"])]
    spec["D"]["1"] = discounts(m4)
    for f in folders:
        for level in range(1, order):
            _delete(spark, f"{f}/kind=down{level}")
    spec["files"] = _index(spark, [f"{f}/kind=model" for f in [*folders, f"{path}/1-0"] if _files(spark, f"{f}/kind=model")])
    if urlparse(path).scheme not in ("", "file"):
        for x in sorted({x for places in spec["files"].values() for x in places}):
            spark.sparkContext.addFile(x)
    return spec


def _index(spark, folders: list[str]) -> dict[str, list[str]]:
    """Files that hold each order's shards: of the model's files, the heads of their blocks are read."""

    def run(batches):
        for batch in batches:
            places, names = [], []
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mapped, at = np.frombuffer(data, np.uint8), 0
                while at < len(mapped):
                    made = Table(mapped, at)
                    names.append(f"{made.level}/{made.number}")
                    places.append(place)
                    at = made.end
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.string())], names=["shard", "path"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folders).select("path", "content")
    out: dict[str, list[str]] = {}
    for r in files.mapInArrow(run, "shard string, path string").distinct().toLocalIterator():
        out.setdefault(r.shard, []).append(r.path)
    return out


def _files(spark, path: str) -> list[str]:
    """URIs of the part files below a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    walk, out = fs.listFiles(where, True), []
    while walk.hasNext():
        name = walk.next().getPath()
        if name.getName().startswith("part-"):
            out.append(name.toString())
    return out


def _delete(spark, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def score(df: DataFrame, spec: dict, *carry: str, text_col: str = "text") -> DataFrame:
    """Carried columns, then n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    places = [f"c{k}" for k in range(len(carry))]
    kept = pick(df, *carry, text_col).toDF(*places, "text")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.schema[:-1])

    def run(batches):
        model = _model(spec)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                raw, at = utf8_buffer(part.column(part.num_columns - 1))
                hashes, sizes = tokens(raw.tobytes(), at)
                known, base, full = model.score(hashes, sizes)
                columns = [sizes, known, np.full(len(sizes), spec["N"], np.int64), base, full]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, columns)], names=[*places, *made])

    return kept.mapInArrow(run, f"{schema}n_tokens long, n_known long, train_tokens long, base_score double, score double").toDF(*carry, *made)


def train_and_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, order: int = ORDER) -> DataFrame:
    """Learn from the rows outside the held-out fold, score all."""
    rows = pick(df, id_col, text_col).toDF("id", "text").withColumn("held_out", in_fold(F.col("id"), folds, held))
    spec = train(rows.where("not held_out"), order=order)
    return score(rows, spec, "id", "held_out").withColumnRenamed("id", id_col)
