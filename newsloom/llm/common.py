"""Helpers shared by the training-data operators.

Shared storage: intermediate tables are cut off from their lineage by writing
them below the folder named in ``spark.checkpoint.dir`` (shared by all
executors), so a lost executor costs a re-read and not a wrong result; see
``newsloom.sources.tables``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.sources.tables import settle as materialize  # noqa: F401  under the name in use here
from newsloom.sources.tables import shared_dir  # noqa: F401

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def with_row_key(df: DataFrame, places: list[str], label: str) -> DataFrame:
    """``df`` under other column names, and row, which tells its rows apart on every reading.

    Rows that come straight from files are known by file and place (nothing is
    written); others are written first.
    """
    try:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return df.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(df.columns, places)], place.alias("row"))
    except AnalysisException:
        return materialize(df.toDF(*places).withColumn("row", F.monotonically_increasing_id()), label)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_fold(doc_id: Column, buckets: int, fold: int) -> Column:
    """crc32 of the id's decimal text falls in ``fold``; a null id hashes as the empty text."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(key.cast("binary")) % buckets) == fold


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary Arrow column, and its n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty, malformed UTF-8 is replaced."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        raw, at = utf8_buffer(column)
        data = raw.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Cut a batch into pieces of about ``limit`` bytes of one column (one row at least)."""
    _, at = utf8_buffer(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])
