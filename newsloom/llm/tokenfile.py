"""Operator 7: token ids as bit-packed binary files.

Format.  A file is a run of blocks and an index of them.  A block is

    magic "NLTB", version u8, bits u8, zero u16,
    block length in bytes u32 (from the magic to the end byte), file number u32,
    n_docs u32, n_ids u32, first id's place in the file u64,
    n_docs x doc_id i64, n_docs x ids of the document u32,
    ids at ``bits`` bits each, least significant bit first, zero-padded to a byte,
    end byte 0x0A

and the index, which closes the file,

    magic "NLTI", number of blocks u32, for each its byte offset u64,
    for each its first id's place u64, length of the index in bytes u32, 0x0A

all little-endian.  ``bits`` is the least that holds the vocabulary.  A reader
finds the index from the file's end and any id's block in it, unpacks a block
with a few numpy operations, and ``read_range`` fetches ids from any place of a
block without unpacking the rest (``read_ids`` from any place of a file).  Documents do not straddle blocks; a null doc_id is written
as the least i64.

Files are written by Spark's own text sink, one row a block, its line separator
being the end byte: bytes pass through it unchanged, the commit protocol covers
lost executors and repeated tasks, and any store that Spark writes to will do.
They are read back with the binaryFile source.

Order: rows are range-partitioned and sorted by doc_id (then by the text's hash,
so that repeated ids fall alike on each run), nulls first; file n holds the n-th
range.  Only per-file totals, one row a file, are gathered to turn places within
files into places overall.

Defined cases: null and empty texts hold the end id alone; an empty table writes
no block; repeated rows each give a row; extra columns are ignored.  Ids are whole
numbers of 64 bits, any other type raises; the least of them reads back as null.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, shared_dir, slices

MAGIC, VERSION, END = b"NLTB", 1, b"\n"
HEAD = struct.Struct("<4sBBHIIIIQ")
INDEX_MAGIC, INDEX_HEAD, INDEX_TAIL = b"NLTI", struct.Struct("<4sI"), struct.Struct("<I")
NO_ID = -(1 << 63)

#: Ids in a block before it is closed, and text bytes aimed at for a file.
BLOCK_IDS, FILE_BYTES = 1 << 18, 32 << 20


def bits_for(vocab: int) -> int:
    """Least number of bits that holds ids 0 .. vocab - 1."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    wide = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(wide.ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from place ``first`` on: each lies within 8 bytes from its first byte."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, first * 2).astype(np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * bits
    raw = np.frombuffer(data, np.uint8)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    span = (bits + 14) // 8
    word = np.zeros(n, np.uint64)
    for k in range(span):
        word |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def make_block(bits: int, file: int, first: int, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    body = doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + pack(ids, bits)
    return HEAD.pack(MAGIC, VERSION, bits, 0, HEAD.size + len(body) + 1, file, len(sizes), len(ids), first) + body


def make_index(offsets: list[int], firsts: list[int]) -> bytes:
    body = INDEX_HEAD.pack(INDEX_MAGIC, len(offsets)) + np.array([*offsets, *firsts], "<u8").tobytes()
    return body + INDEX_TAIL.pack(len(body) + INDEX_TAIL.size + 1)


def read_index(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of the blocks, places of their first ids) of a file."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = len(data) - INDEX_TAIL.unpack_from(data, len(data) - 1 - INDEX_TAIL.size)[0] if len(data) > INDEX_HEAD.size + INDEX_TAIL.size else -1
    if at < 0 or data[-1:] != END or data[at : at + 4] != INDEX_MAGIC:
        raise ValueError("a file without its index")
    n = INDEX_HEAD.unpack_from(data, at)[1]
    return tuple(np.frombuffer(data, "<u8", 2 * n, at + INDEX_HEAD.size).reshape(2, n))


def blocks(data: bytes):
    """(offset, bits, file, n_docs, n_ids, first) of each block of a file, by its index."""
    for at in read_index(data)[0].tolist():
        magic, version, bits, _, size, file, n_docs, n_ids, first = HEAD.unpack_from(data, at)
        if magic != MAGIC or version != VERSION or data[at + size - 1 : at + size] != END:
            raise ValueError(f"no block at byte {at}")
        yield at, bits, file, n_docs, n_ids, first


def read_ids(data: bytes, place: int, n: int) -> np.ndarray:
    """``n`` ids from a place of the file on, of the blocks that hold them."""
    offsets, firsts = read_index(data)
    out, k = [np.zeros(0, np.uint32)], int(np.searchsorted(firsts, place, "right")) - 1
    while n > 0 and k < len(offsets):
        at, skip = int(offsets[k]), place - int(firsts[k])
        take = min(n, HEAD.unpack_from(data, at)[7] - skip)
        out.append(read_range(data, at, skip, take))
        place, n, k = place + take, n - take, k + 1
    return np.concatenate(out)


def read_block(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of the block at a byte offset."""
    _, _, bits, _, size, _, n_docs, n_ids, _ = HEAD.unpack_from(data, at)
    body = at + HEAD.size
    docs = np.frombuffer(data, "<i8", n_docs, body)
    sizes = np.frombuffer(data, "<u4", n_docs, body + 8 * n_docs)
    return docs, sizes, unpack(data[body + 12 * n_docs : at + size - 1], bits, n_ids)


def read_range(data: bytes, at: int, first: int, n: int) -> np.ndarray:
    """``n`` ids from place ``first`` of the block at a byte offset, reading only their bytes."""
    _, _, bits, _, _, _, n_docs, _, _ = HEAD.unpack_from(data, at)
    body = at + HEAD.size + 12 * n_docs
    lo, hi = first * bits >> 3, ((first + n) * bits + 7) >> 3
    return unpack(data[body + lo : body + hi], bits, n, 0) if (first * bits) % 8 == 0 else _unaligned(data[body + lo : body + hi], bits, n, first * bits & 7)


def _unaligned(data: bytes, bits: int, n: int, skip: int) -> np.ndarray:
    raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[skip : skip + n * bits].reshape(n, bits)
    return (raw.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write(df: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts with a tokenizers file and write them under ``path`` in order of id."""
    from .bpe import bpe_from_json

    kept = pick(df, id_col, text_col)
    bits = bits_for(bpe_from_json(tokenizer)[0].get_vocab_size(with_added_tokens=True))
    volume = kept.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    files = max(1, -(-volume // FILE_BYTES))
    order = [F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))]
    placed = kept.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches):
        from .bpe import SLICE_BYTES, json_encoder

        encoder, file, place = json_encoder(tokenizer), TaskContext.get().partitionId(), 0
        at, offsets, firsts = 0, [], []
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                docs = part.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                ids, edges = encoder.encode(part.column(1))
                ended = edges + np.arange(len(edges))
                closed = np.full(ended[-1], end_id, np.uint32)
                mine = np.ones(len(closed), bool)
                mine[ended[1:] - 1] = False
                closed[mine] = ids
                lo, out = 0, []
                while lo < len(docs):  # a block ends with the document that fills it
                    hi = min(len(docs), int(np.searchsorted(ended, ended[lo] + BLOCK_IDS, "left")))
                    hi = max(hi, lo + 1)
                    out.append(make_block(bits, file, place, docs[lo:hi], np.diff(ended[lo : hi + 1]), closed[ended[lo] : ended[hi]]))
                    offsets.append(at)
                    firsts.append(place)
                    at += len(out[-1]) + 1
                    place, lo = place + int(ended[hi] - ended[lo]), hi
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])
        if offsets:
            yield pa.RecordBatch.from_arrays([pa.array([make_index(offsets, firsts)], pa.binary())], names=["block"])

    made = placed.mapInArrow(run, "block binary")
    made.select(F.col("block").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, place, n_tokens, ids binary) of every document, unpacked from the files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches):
        from .bpe import packed

        for batch in batches:
            for data in batch.column(0).to_pylist():
                for at, _, file, n_docs, _, first in blocks(data):
                    docs, sizes, ids = read_block(data, at)
                    edge = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n_docs, file, np.int64)),
                            pa.array(docs, pa.int64(), mask=docs == NO_ID),
                            pa.array(edge[:-1] + first),
                            pa.array(sizes.astype(np.int64)),
                            packed(ids, edge),
                        ],
                        names=["file", "doc_id", "place", "n_tokens", "ids"],
                    )

    return raw.mapInArrow(run, "file long, doc_id long, place long, n_tokens long, ids binary")


def write_and_digest(df: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write, read back, and return per document its place overall and a checksum of its ids."""
    spark = df.sparkSession
    path = shared_dir(spark, "tokens")
    write(df, tokenizer, path, end_id, id_col, text_col)
    docs = materialize(read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "token-index")
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(base, "file").select(
        F.col("doc_id").alias(id_col),
        (F.col("base") + F.col("place")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
