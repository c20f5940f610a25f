import zlib

import numpy as np

from newsloom.llm import quality


def docs_and_labels(spark, n=400):
    rng = np.random.default_rng(0)
    words = ["river", "of", "stone", "the", "green", "and", "hill"]
    rows, labels = [], []
    for k in range(n):
        good = k % 2
        w = rng.choice(words, 30).tolist()
        rows.append((k, " ".join(w) + "." if good else " ".join(f"{x}$$$" for x in w), k % 3))
        labels.append((k, good if k % 50 else None, 0, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy_and_folds(spark):
    docs, labels = docs_and_labels(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 400
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.98


def test_odd_rows_no_labels_and_empty_tables(spark, odd_docs, no_docs):
    _, labels = docs_and_labels(spark, 10)
    assert quality.classify(odd_docs, labels).count() == odd_docs.count()
    assert {r.score for r in quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0
    kept = quality.keep_good(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_features_of_empty_texts_are_finite():
    raw = np.frombuffer("a b\na b".encode(), np.uint8)
    x = quality.features(raw, np.array([0, 0, 7, 7]))
    assert x.shape == (3, len(quality.FEATURES)) and np.isfinite(x).all() and (x[0] == x[2]).all()


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.predict(quality.fit(x, y), x) >= 0.5) == y).mean() > 0.9
    assert (quality.predict(quality.fit(x, np.ones(2000)), x) > 0.9).all()


def test_repeated_rows_leave_the_balance_of_labels(spark):
    docs, labels = docs_and_labels(spark)
    one = quality.train(docs, labels, train_rows=100)["intercept"]
    many = docs
    for _ in range(2):
        many = many.unionByName(many)
    twice = quality.train(many, labels.unionByName(labels), train_rows=100)["intercept"]
    assert abs(one) < 0.6 and abs(twice) < 0.6


def test_names_in_use_inside_are_kept(spark):
    docs, labels = docs_and_labels(spark, 60)
    odd = docs.selectExpr("*", "doc_id * 2 as _score", "doc_id as c0", "'x' as h")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and all(r._score == 2 * r.doc_id and r.c0 == r.doc_id for r in kept.collect())
