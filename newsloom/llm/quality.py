"""Operator 8: quality classifier, a generalised additive model with pairwise interactions.

Features are read off the text alone.  Each is cut into bins at quantiles of the
training rows.  Boosting visits the features in turn, round after round; a visit
fits a shallow tree (two levels) to the gradients summed by bin and adds its
leaves, shrunken, to the feature's lookup table.  Then the pairs whose binned
gradients leave the most to gain get two-dimensional tables, boosted in turn
likewise.  A score is the logistic of the intercept plus one table entry for each
feature and pair, added up for whole batches of rows.

Training ids are the ``train_rows`` labelled ids (a documented bound) with the
smallest hashes outside the held-out fold; an id that is labelled more than once
has the label of most of its rows (the larger one of a tie).  Where documents
repeat an id, the rows with the smallest hashes of id and text are taken, up to
the same bound: no choice looks at labels.  Features, and no texts, come to the
driver.

Defined cases: null and empty texts have features of their own and a score; with
no labelled rows every score is 0.5 (predicted 1); null labels do not train;
repeated rows each give a row; a null doc_id hashes as the empty text; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, pick, slices, utf8_buffer

#: The classes of bytes that are counted.
CLASSES = {
    "lower": bytes(range(0x61, 0x7B)),
    "upper": bytes(range(0x41, 0x5B)),
    "digit": bytes(range(0x30, 0x3A)),
    "mark": b".,;:'\"()-",
    "symbol": b"#$%&*@^~+=<>_/\\{}[]`",
    "pipe": b"|",
    "call": b"!?",
    "high": bytes(range(0x80, 0x100)),
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
}
FEATURES = ("bytes", "words", "word_length", *CLASSES, "variety", "adjacent", "top_share", "short", "repeated_lines", "line_words")

TRAIN_ROWS, BINS, ROUNDS, PAIRS, PAIR_BINS, PAIR_ROUNDS, RATE = 20_000, 32, 200, 6, 8, 100, 0.1

_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS_OF[list(_chars)] = _k


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of features for each text of a UTF-8 buffer."""
    n, width = len(at) - 1, len(CLASSES) + 1
    size = np.diff(at)
    row = np.repeat(np.arange(n) * width, size)
    counts = np.bincount(row + _CLASS_OF[raw], minlength=n * width).reshape(n, width)[:, :-1]
    data, more = raw.tobytes(), np.zeros((n, 7))
    for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
        text = data[a:b]
        words = text.split()
        if not words:
            continue
        times = Counter(words)
        lines = [x for x in text.split(b"\n") if x]
        more[k] = (
            len(words),
            np.log1p(len(times)) / np.log1p(len(words)),
            sum(map(eq, words, itertools.islice(words, 1, None))) / len(words),
            max(times.values()) / len(words),
            sum(v for w, v in times.items() if len(w) <= 3) / len(words),
            1 - len(set(lines)) / max(1, len(lines)),
            len(words) / max(1, len(lines)),
        )
    words = more[:, :1]
    head = [np.log1p(size)[:, None], np.log1p(words), size[:, None] / np.maximum(words, 1), counts / np.maximum(size, 1)[:, None]]
    return np.hstack([*head, more[:, 1:6], np.log1p(more[:, 6:])])


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def tree_over_bins(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin: the best cut of a run of bins, then of its parts."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return out
    return np.concatenate([tree_over_bins(g[:cut], h[:cut], depth - 1), tree_over_bins(g[cut:], h[cut:], depth - 1)])


def tree_over_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One cut by either feature, then one of each part by the other; the better order wins."""
    best, gain = None, -1.0
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        gl, hl = np.cumsum(a.sum(1))[:-1], np.cumsum(b.sum(1))[:-1]
        for cut in range(1, len(a)):
            parts = [tree_over_bins(p.sum(0), q.sum(0), 1) for p, q in ((a[:cut], b[:cut]), (a[cut:], b[cut:]))]
            won = sum(float((v * p.sum(0)).sum() - 0.5 * (v * v * q.sum(0)).sum()) for v, p, q in zip(parts, (a[:cut], a[cut:]), (b[:cut], b[cut:])))
            if won > gain:
                gain, table = won, np.vstack([np.tile(parts[0], (cut, 1)), np.tile(parts[1], (len(a) - cut, 1))])
                best = table if axis == 0 else table.T
    return np.zeros_like(g) if best is None else best


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Lookup tables from a feature matrix and 0/1 labels."""
    if not len(y):
        return {"intercept": 0.0, "edges": [], "tables": [], "pair_edges": [], "pairs": []}
    rate = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(rate / (1 - rate)))
    edges = [bin_edges(c, BINS) for c in x.T]
    binned = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    at = np.full(len(y), intercept)
    for _ in range(ROUNDS):
        for table, b in zip(tables, binned):
            p = _sigmoid(at)
            step = RATE * tree_over_bins(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            table += step
            at += step[b]
    pair_edges = [bin_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(pair_edges, x.T)]
    shape = [len(e) + 1 for e in pair_edges]
    cells = lambda i, j, v: np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])
    p = _sigmoid(at)
    left = {(i, j): float((cells(i, j, y - p) ** 2 / (cells(i, j, p * (1 - p)) + 1)).sum()) for i, j in itertools.combinations(range(len(edges)), 2) if shape[i] > 1 and shape[j] > 1}
    chosen = sorted(left, key=lambda k: (-left[k], k))[:PAIRS]
    pairs = [(i, j, np.zeros((shape[i], shape[j]))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            p = _sigmoid(at)
            step = RATE * tree_over_pair(cells(i, j, y - p), cells(i, j, p * (1 - p)))
            table += step
            at += step[coarse[i], coarse[j]]
    return {"intercept": intercept, "edges": edges, "tables": tables, "pair_edges": pair_edges, "pairs": pairs}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    at = np.full(len(x), model["intercept"])
    for edges, table, c in zip(model["edges"], model["tables"], x.T):
        at += table[np.searchsorted(edges, c, "right")]
    coarse = {k: np.searchsorted(model["pair_edges"][k], x[:, k], "right") for i, j, _ in model["pairs"] for k in (i, j)}
    for i, j, table in model["pairs"]:
        at += table[coarse[i], coarse[j]]
    return _sigmoid(at)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    key = F.col(f"`{id_col}`")
    chosen = pick(labels, id_col, label_col).toDF("id", "label").where("id is not null and label is not null").where(~in_fold(F.col("id"), folds, held))
    chosen = chosen.groupBy("id").agg((F.avg((F.col("label") >= 1).cast("int")) >= 0.5).cast("long").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = pick(docs, id_col, text_col).where(~in_fold(key, folds, held)).toDF("id", "words")
    # at most train_rows pairs of numbers
    wanted = texts.join(F.broadcast(chosen), "id").select("label", "words", F.xxhash64("id", "words").alias("h"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "words", 1 << 20):
                x = features(*utf8_buffer(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "h", "x"])

    rows = wanted.mapInArrow(run, "label long, h long, x array<double>").orderBy("h", "x").limit(train_rows).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy().astype(float))


def score(df: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``df``, then a double; names are taken by place, so any name of ``df`` will do."""
    at = df.columns.index(text_col)
    places = [f"c{k}" for k in range(len(df.columns))]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(places, df.schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, places[at], 1 << 20):
                scores = predict(model, features(*utf8_buffer(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*places, "score"])

    return df.toDF(*places).mapInArrow(run, f"{schema}, score double").toDF(*df.columns, score_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = train(docs, labels, folds=folds, held=held, id_col=id_col, text_col=text_col)
    scored = score(pick(docs, id_col, text_col).toDF("id", "text"), model)
    return scored.select(F.col("id").alias(id_col), in_fold(F.col("id"), folds, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """The documents that the classifier does not reject, in their own columns."""
    model = train(docs, labels, folds=folds, held=held, id_col=id_col, text_col=text_col)
    places = [f"c{k}" for k in range(len(docs.columns))]
    scored = score(docs.toDF(*places), model, places[docs.columns.index(text_col)])
    return scored.where("score >= 0.5").drop("score").toDF(*docs.columns)
