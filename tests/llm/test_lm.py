import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from newsloom.llm import lm

END, BEGIN = "</s>", "<s>"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def held(i):
    return zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1


def brute(rows, order=3):
    """(doc_id, held, n_tokens, n_known, N, base, score) by dictionaries, and the probability of a word after words."""
    uni, grams = Counter(), Counter()
    padded = lambda t: [BEGIN] * (order - 1) + [*words_of(t), END]
    for i, t in rows:
        if not held(i):
            seq = padded(t)
            uni.update(seq[order - 1 :])
            grams.update(tuple(seq[k - order + 1 : k + 1]) for k in range(order - 1, len(seq)))
    n, v = sum(uni.values()), len(uni)
    counts = {order: grams}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    of = lambda xs: [sum(1 for x in xs if x == k) for k in (1, 2, 3, 4)]
    d = {m: lm.discounts(of(counts[m].values())) for m in counts}
    cut = lambda c, ds: ds[min(c, 3) - 1] if c else 0.0
    after = {m: defaultdict(list) for m in counts}
    for m in counts:
        for g, c in counts[m].items():
            after[m][g[:-1]].append(c)

    def p(w, *context):
        context = context[-(order - 1) :]
        m = len(context) + 1
        seen = after[m].get(context)
        if m == 1:
            b = sum(seen) if seen else 0
            spare = sum(cut(c, d[1]) for c in seen) / b if seen else 1.0
            return (max(counts[1][w,] - cut(counts[1][w,], d[1]), 0) / b if b else 0) + spare / (v + 1)
        lower = p(w, *context[1:])
        if not seen:
            return lower
        c = counts[m][(*context, w)]
        return (max(c - cut(c, d[m]), 0) + sum(cut(x, d[m]) for x in seen) * lower) / sum(seen)

    out = []
    for i, t in rows:
        seq = padded(t)
        own = seq[order - 1 :]
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        full = sum(math.log10(p(seq[k], *seq[k - order + 1 : k])) for k in range(order - 1, len(seq)))
        out.append((i, held(i), len(own), sum(uni[w] > 0 for w in own), n, base, full))
    return out, p, [*uni, "never seen"]


def compare(got, want):
    key = lambda r: repr((r[0], r[2]))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_equals_dictionaries_over_many_shards(spark, odd_docs, no_docs, monkeypatch, order):
    monkeypatch.setattr(lm, "GRAM_BYTES", 30_000)
    monkeypatch.setattr(lm, "WORD_BYTES", 30_000)
    monkeypatch.setattr(lm, "FLUSH_TOKENS", 2_000)
    monkeypatch.setattr(lm, "HEAVY", 3)
    monkeypatch.setattr(lm, "INDEXED", 40)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    compare(lm.train_and_score(odd_docs, order=order).collect(), brute(rows, order)[0])
    assert lm.train_and_score(no_docs, order=order).count() == 0


def test_nothing_to_learn_from(spark):
    alone = next(i for i in range(99) if held(i))
    (r,) = lm.train_and_score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_probabilities_add_up_to_one():
    rows = [(k, " ".join("abcabdaacdx"[k % 7 :])) for k in range(30)]
    _, p, vocabulary = brute(rows)
    for context in ((BEGIN, BEGIN), (BEGIN, "a"), ("a", "b"), ("b", "nowhere"), ("nowhere", "b")):
        assert sum(p(w, *context) for w in vocabulary) == pytest.approx(1.0)


def test_counts_over_a_byte_survive_packing():
    import numpy as np

    x = np.array([1, 254, 255, 70_000, 3])
    data = b"zz" + lm._pack_counts(x) + b"tail"
    back, at = lm._unpack_counts(data, 5, 2)
    assert back.tolist() == x.tolist() and data[at:] == b"tail"


def test_prose_of_many_documents(spark, monkeypatch):
    import random

    monkeypatch.setattr(lm, "GRAM_BYTES", 4_000)
    monkeypatch.setattr(lm, "HEAVY", 5)
    monkeypatch.setattr(lm, "HEAVY_SHARE", 0.001)
    monkeypatch.setattr(lm, "INDEXED", 20)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices([f"w{i}" for i in range(40)], [1 / (i + 1) for i in range(40)], k=rng.randrange(60)))) for k in range(150)]
    compare(lm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows)[0])


def test_order_is_two_or_more(spark, odd_docs):
    with pytest.raises(ValueError):
        lm.train(odd_docs, order=1)
