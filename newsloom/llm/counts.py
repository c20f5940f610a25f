"""Operator 4: token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are never recomputed from
documents: they are the sum of signed deltas.  A change row carries

    op         'insert', 'delete' or 'revise'
    source, lang, tokenizer   the group
    n_tokens   the document's count (of a delete: the count that goes)
    old_tokens the count that a revision replaces

and becomes (+1, +n), (-1, -n) or (0, n - old).  A batch of changes is
aggregated to one delta row a group (with partial sums before the shuffle, so a
group that holds a third of all rows costs no more than another) and written to
a folder of its own.  The batch is committed by one rename of a small marker
file, which bears the batch id as its name and names that folder: a batch id has
one marker, so two writers of one batch count once, and a batch whose writer
died is invisible and can be repeated until it succeeds.

``compact`` folds the commits into one table with the ids of all batches in it
and publishes both by one rename of a numbered snapshot file.  Readers take the
newest snapshot and the commits whose ids it does not hold, so a driver that
dies between any two steps, and files that were to be deleted and are still
there, change no total.  Deltas and folds that a snapshot replaced are deleted by
the compaction after it, so that readers who have begun can end.

Defined cases: null source, language or tokenizer form groups of their own; null
counts are 0; unknown ops raise ``ValueError``; an empty batch commits no rows;
groups whose documents and tokens both reach 0 vanish from the totals; extra
columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, shared_dir, slices, word_count

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """One signed row a group."""
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    known = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    sign = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("null")))).cast("int"))
    tokens = F.when(F.col("op") == "revise", n("n_tokens") - n("old_tokens")).otherwise(F.col("sign") * n("n_tokens"))
    signed = changes.withColumn("sign", sign)
    return signed.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(tokens).alias("n_tokens"))


class TokenRollup:
    """A rollup kept under a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "rollup")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("staged", "deltas", "commits", "snapshots"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))

    def _get(self, name: str) -> str:
        with_ = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        finally:
            with_.close()

    def _put(self, name: str, text: str) -> bool:
        """A small file that appears whole or not at all; False if its name is taken."""
        staged, goal = self._path(f"{self.path}/staged/{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        out = self._fs.create(staged)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(goal) or not self._fs.rename(staged, goal):
            self._fs.delete(staged, False)
            return False
        return True

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _snapshot(self) -> dict:
        names = self._names("snapshots")
        return json.loads(self._get(f"snapshots/{names[-1]}")) if names else {"number": 0, "fold": None, "replaced": []}

    def _folded(self, snapshot: dict, ids: list[str]) -> set[str]:
        """Which of some batch ids a snapshot holds."""
        if not snapshot["fold"] or not ids:
            return set()
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/{snapshot['fold']}/batches")
        return {r.batch for r in held.where(F.col("batch").isin(ids)).collect()}

    def _live(self, snapshot: dict) -> dict[str, str]:
        """Committed batches that are not in the snapshot, and their folders. Markers that a crashed compaction left are not among them."""
        names = self._names("commits")
        gone = self._folded(snapshot, names)
        return {name: self._get(f"commits/{name}") for name in names if name not in gone}

    def is_committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/commits/{batch_id}")) or bool(self._folded(self._snapshot(), [batch_id]))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch_id):
            raise ValueError("a batch id has letters, digits and hyphens")
        if self.is_committed(batch_id):
            return False
        folder = f"deltas/{batch_id}-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{folder}")
        if self._put(f"commits/{batch_id}", folder):
            return True
        self._delete(folder)
        return False

    def _log(self, snapshot: dict, live: dict[str, str]) -> DataFrame:
        folders = ([f"{self.path}/{snapshot['fold']}/totals"] if snapshot["fold"] else []) + [f"{self.path}/{x}" for x in live.values()]
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*folders)

    def _totals(self, snapshot: dict, live: dict[str, str]) -> DataFrame:
        summed = self._log(snapshot, live).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens)."""
        snapshot = self._snapshot()
        return self._totals(snapshot, self._live(snapshot))

    def compact(self) -> bool:
        """Fold all commits into one; False if another compaction was first (nothing is lost, and nothing of this one is kept)."""
        old = self._snapshot()
        live = self._live(old)
        fold = f"deltas/fold-{uuid.uuid4().hex}"
        self._totals(old, live).write.parquet(f"{self.path}/{fold}/totals")
        batches = self.spark.createDataFrame([(x,) for x in live], "batch string")
        if old["fold"]:
            batches = batches.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/{old['fold']}/batches"))
        batches.write.parquet(f"{self.path}/{fold}/batches")
        number = old["number"] + 1
        new = {"number": number, "fold": fold, "replaced": [*live.values(), *([old["fold"]] if old["fold"] else [])]}
        if not self._put(f"snapshots/{number:012d}", json.dumps(new)):
            self._delete(fold)
            return False
        for name in live:
            self._delete(f"commits/{name}")
        for name in self._names("snapshots"):
            if int(name) < number:
                self._delete(f"snapshots/{name}")
        for folder in old["replaced"]:
            self._delete(folder)
        return True


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", *carry: str) -> DataFrame:
    """(carried columns, n_words, n_tokens) of every row's whole text by a tokenizers file. Carried columns may have any names but these two."""
    places = [f"c{k}" for k in range(len(carry))]
    kept = pick(df, *carry, text_col).toDF(*places, "text")
    kept = kept.select(*places, word_count(F.col("text")).alias("n_words"), "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", n_tokens long"

    def run(batches):
        from .bpe import SLICE_BYTES, json_encoder

        encoder = json_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n = pa.array(np.diff(encoder.encode(part.column(part.num_columns - 1))[1]), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n], names=[*part.schema.names[:-1], "n_tokens"])

    return kept.mapInArrow(run, schema).toDF(*carry, "n_words", "n_tokens")


def rollup_documents(docs: DataFrame, tokenizer: str, version: str, interim: str = "words") -> TokenRollup:
    """Counts of a table, as its history would make them.

    Documents are loaded with word counts under an interim version; these are
    deleted and inserted under ``version``, with the same provisional counts;
    then revised to token counts.  Every batch is sent twice and counts once; the
    commits are folded in between.
    """
    counted = materialize(count_tokens(docs, tokenizer, "text", "source", "lang"), "token-counts")
    none = F.lit(None).cast("long").alias("old_tokens")
    of = lambda op, name, n, old=none: counted.select(F.lit(op).alias("op"), "source", "lang", F.lit(name).alias("tokenizer"), F.col(n).alias("n_tokens"), old)
    batches = {
        "load": of("insert", interim, "n_words"),
        "migrate": of("delete", interim, "n_words").unionByName(of("insert", version, "n_words")),
        "recount": of("revise", version, "n_tokens", F.col("n_words").alias("old_tokens")),
    }
    rollup = TokenRollup(docs.sparkSession)
    for k, (name, changes) in enumerate(batches.items()):
        rollup.apply(name, changes)
        rollup.apply(name, changes)
        if k == 1:
            rollup.compact()
    return rollup
