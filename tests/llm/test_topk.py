import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, score long, rank int"


def brute(rows, k, ask):
    good = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in good:
        if ask(i):
            queries[i] = min(queries.get(i, v), v)
    for q, u in queries.items():
        found = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in good if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_equals_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.choice([-0.5, 0.0, 0.25, 0.1], 6).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [None] * 6), (303, [float("nan")] + [0.0] * 5), (304, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (320, [1.0, 2.0]), (20, rows[20][1]), (340, [3e4] * 6)]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA)
    got = topk.search(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, lambda i: i % 20 == 0)


def test_fewer_candidates_than_k_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2, "x", 3, 4), (7, [2.0], 1, 2, "x", 3, 4)], SCHEMA)
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 7, 64 * 128)]
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_components_that_are_too_large_raise(spark):
    import pytest

    for x in (1e30, 1e8):
        df = spark.createDataFrame([(0, [x] * 3, 1, 2, "x", 3, 4), (7, [x] * 3, 1, 2, "x", 3, 4)], SCHEMA.replace("array<float>", "array<double>"))
        with pytest.raises(Exception, match="too large"):
            topk.search(df, F.col("vec_id") % 20 == 0).collect()
