"""Links between sets at a least Jaccard, found and verified in the tasks where sets meet.

Sets are told apart by 64-bit hashes of their tokens.  Each distinct set is kept once, in Arrow files of the shared folder
that tasks map into memory, with its tokens in one order common to all (rare in a sample first; any order is right) and
parity bits.  The first n - ceil(least n) + 1 tokens of a set are dealt by token; sets that link share one of them.  Where
sets of a token meet, sizes, places and parity bits bound what they can share, and what passes is verified on the mapped
sets at once, by the task that holds the first token that both prefixes share.  So no pair is moved but the links.
"""

from __future__ import annotations

import math
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.sources.tables import settle, shared_dir

#: Sets in which frequent tokens are looked for, and how many of them have a place in the order.
SAMPLE, FREQUENT = 10_000, 1 << 17
#: Words of 64 parity bits of a set; rows and pairs that a task looks at at once; tokens of sets that it keeps unpacked.
PARITY, ROWS, PAIRS, UNPACKED = 16, 1 << 18, 1 << 17, 1 << 20

_OPEN: dict[str, tuple] = {}


def _file(path: str):
    """A file of the shared folder, mapped where it is local to the file system."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return pa.memory_map(unquote(url.path))
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _sets(path: str) -> tuple:
    """(keys, offsets, tokens, parity bits) of a file."""
    if path not in _OPEN:
        batch = pa.ipc.open_file(_file(path)).get_batch(0)
        toks = batch.column(1)
        parity = np.frombuffer(batch.column(2).buffers()[1], np.uint64).reshape(-1, PARITY)
        _OPEN[path] = batch.column(0), toks.offsets.to_numpy(), toks.values.to_numpy(), parity
    return _OPEN[path]


def _write(path: str, batch: pa.RecordBatch) -> None:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0])
    with store.open_output_stream(name) as out, pa.ipc.new_file(out, batch.schema) as made:
        made.write_batch(batch)


def prefix_lengths(n: np.ndarray, least: float) -> np.ndarray:
    return n - np.ceil(n * least - 1e-9).astype(np.int64) + 1


def _parity(owner: np.ndarray, toks: np.ndarray, sets: int) -> np.ndarray:
    odd = np.zeros((sets, PARITY * 64), np.uint8)
    for lo in range(0, sets, 1 << 14):  # counts of some sets at a time
        a, b = np.searchsorted(owner, (lo, lo + (1 << 14)))
        place = (toks[a:b].view(np.uint64) >> np.uint64(9)) % np.uint64(PARITY * 64)
        some = min(sets - lo, 1 << 14)
        odd[lo : lo + some] = (np.bincount((owner[a:b] - lo) * PARITY * 64 + place.astype(np.int64), minlength=some * PARITY * 64) & 1).reshape(some, -1)
    return np.packbits(odd, axis=1, bitorder="little")


def classes_and_links(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (k, h, toks: distinct hashes as array<long>, h a digest of the set): (k, rep) of every row that has tokens, and (a, b, jaccard), a > b, of representatives."""
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession, "sets")
    step = max(1, rows.select("k").count() // SAMPLE)
    seen = rows.where(F.pmod(F.xxhash64("k"), F.lit(step)) == 0).select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).where("n > 1")
    top = seen.orderBy(F.desc("n"), "tok").limit(FREQUENT).toPandas()
    often = np.argsort(top["tok"].to_numpy(np.int64))
    often, order = top["tok"].to_numpy(np.int64)[often], (len(top) - often).astype(np.int64)
    kind = to_arrow_type(rows.schema["k"].dataType)

    def ranks(toks):
        """A token's place in the order: above zero if it is frequent, and rising with its count."""
        at = np.minimum(np.searchsorted(often, toks), max(len(often) - 1, 0))
        return np.where(often[at] == toks, order[at], 0) if len(often) else np.zeros(len(toks), np.int64)

    def keep(batches):
        """Each digest's first row goes into the task's file."""
        path, last, rep, parts = f"{folder}/{uuid.uuid4().hex}.arrow", None, None, []
        for batch in batches:
            # here and not in the plan, where a filter would work the tokens out once more
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            keys, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            reps, first = [], []
            for place, digest in enumerate(digests):
                if digest != last:
                    last, rep = digest, keys[place]
                    first.append(place)
                reps.append(rep)
            kept = batch.column(2).take(pa.array(first, pa.int32()))
            toks, n = kept.flatten().to_numpy(), kept.value_lengths().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            toks = toks[np.lexsort((toks, ranks(toks), owner))]
            parts.append((batch.column(0).take(pa.array(first, pa.int32())), n, toks, _parity(owner, toks, len(n))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reps, kind), pa.array([path] * len(keys), pa.string())], names=["k", "rep", "file"])
        if parts and sum(len(p[1]) for p in parts):
            sizes = np.concatenate([p[1] for p in parts])
            toks = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate([p[2] for p in parts])))
            bits = np.concatenate([p[3] for p in parts])
            parity = pa.Array.from_buffers(pa.binary(PARITY * 8), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(bits).tobytes())])
            _write(path, pa.RecordBatch.from_arrays([pa.concat_arrays([p[0] for p in parts]), toks, parity], names=["k", "toks", "parity"]))

    shape = rows.schema["k"].dataType.simpleString()
    together = rows.select("k", "h", "toks").repartition("h").sortWithinPartitions("h", "k")
    members = settle(together.mapInArrow(keep, f"k {shape}, rep {shape}, file string"), "members")
    files = sorted(r.file for r in members.where("k = rep").select("file").distinct().collect())

    def prefixes(batches):
        for batch in batches:
            for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, offsets, toks, _ = _sets(path)
                for lo in range(0, len(offsets) - 1, 1 << 12):
                    starts = offsets[lo : lo + (1 << 12) + 1].astype(np.int64)
                    n = np.diff(starts)
                    want = prefix_lengths(n, least)
                    own = np.repeat(np.arange(len(n)), want)
                    pos = np.arange(len(own)) - np.repeat(np.cumsum(want) - want, want)
                    columns = [toks[starts[own] + pos], (number << 32) + lo + own, n[own].astype(np.int32), pos.astype(np.int32)]
                    for a in range(0, len(own), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns], names=["tok", "id", "n", "pos"])

    def meet(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= ROWS:
                tok, *rest = (np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(tok, tok[-1]))  # the last token may go on
                if cut:
                    yield from pairs(tok[:cut], *(c[:cut] for c in rest))
                held = [[tok[cut:], *(c[cut:] for c in rest)]]
        if held:
            yield from pairs(*(np.concatenate(c) for c in zip(*held)))

    def pairs(tok, ids, n, pos):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        nodes, node = np.unique(ids, return_inverse=True)
        place, sets = nodes & 0xFFFFFFFF, {f: _sets(files[f]) for f in np.unique(nodes >> 32).tolist()}
        of = [sets[f] for f in (nodes >> 32).tolist()]
        parity = np.empty((len(nodes), PARITY), np.uint64)
        for f, held in sets.items():
            here = (nodes >> 32) == f
            parity[here] = held[3][place[here]]
        group = np.cumsum(np.concatenate(([0], tok[1:] != tok[:-1]))) << 32
        # the largest set that fits in size and can share enough with what is left from here on
        most = np.minimum(np.floor(n / least + 1e-9), np.floor((n - pos) * ((1 + least) / least) + 1e-6) - n).astype(np.int64)
        ends = np.maximum(np.searchsorted(group + n, group + np.maximum(most, 0), side="right"), np.arange(len(tok)) + 1)
        many = ends - np.arange(len(tok)) - 1
        total, lo, full, unpacked = np.cumsum(many), 0, {}, 0

        def tokens(row, end=None):
            x = node[row]
            _, offsets, toks, _ = of[x]
            start = offsets[place[x]]
            return toks[start : offsets[place[x] + 1] if end is None else start + end].tolist()

        while lo < len(tok):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
            a = np.repeat(np.arange(lo, hi), many[lo:hi])
            b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - many[lo:hi] - before, many[lo:hi])
            lo, links = hi, []
            for at in range(0, len(a), PAIRS):
                x, y = a[at : at + PAIRS], b[at : at + PAIRS]
                both = n[x] + n[y]
                need = np.ceil(both * (least / (1 + least)) - 1e-9).astype(np.int64)
                able = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
                x, y, both, need = x[able], y[able], both[able], need[able]
                apart = np.bitwise_count(parity[node[x]] ^ parity[node[y]]).sum(axis=1, dtype=np.int64)
                able = apart <= both - 2 * need
                x, y = x[able], y[able]
                heads = {r: frozenset(tokens(r, pos[r])) for r in np.unique(np.concatenate((x, y))).tolist()}
                for p, q in zip(x.tolist(), y.tolist()):
                    if not heads[p].isdisjoint(heads[q]):
                        continue  # they meet at an earlier token too
                    if unpacked > UNPACKED:
                        full, unpacked = {}, 0
                    for r in (p, q):
                        if node[r] not in full:
                            full[node[r]] = frozenset(tokens(r))
                            unpacked += int(n[r])
                    shared = len(full[node[p]] & full[node[q]])
                    jaccard = shared / (int(n[p]) + int(n[q]) - shared)
                    if jaccard >= least:
                        k, other = (of[node[r]][0][int(place[node[r]])].as_py() for r in (p, q))
                        links.append((max(k, other), min(k, other), jaccard))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*links), (kind, kind, pa.float64()))], names=["a", "b", "jaccard"])

    if not files:
        return members.select("k", "rep"), spark.createDataFrame([], f"a {shape}, b {shape}, jaccard double")
    listed = spark.createDataFrame(list(enumerate(files)), "file int, path string").repartition(len(files))
    dealt = listed.mapInArrow(prefixes, "tok long, id long, n int, pos int").repartition("tok").sortWithinPartitions("tok", "n")
    return members.select("k", "rep"), dealt.mapInArrow(meet, f"a {shape}, b {shape}, jaccard double")
