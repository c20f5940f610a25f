import random

import numpy as np
import pytest

from newsloom.llm import shingles

COLUMNS = "doc_id long, text string"


def brute(rows, width=5):
    """Ids that stay, by all pairs of sets of word tuples."""
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in low.replace("\t", " ").replace("\n", " ").split(" ") if w]

    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append((rows[i][0] is None, rows[i][0] or 0))
    return sorted(min(g) for g in groups.values())


def near_rows(seed=3):
    """Texts with edits from none to a third of the words, chains, shared lines, repeated rows and texts of few words."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    line = [f"line{k}" for k in range(30)]
    rows = []
    for k in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 8, 9, 40, 200, 600]))]
        rows.append(base + (line if k % 2 else []))
        for _ in range(rng.randrange(4)):
            base = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.01, 0.02, 0.03, 0.04, 0.1]))):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append(base + (line if rng.random() < 0.5 else []))
    rng.shuffle(rows)
    out = [(k * 7 % 1009, " ".join(r)) for k, r in enumerate(rows)]
    eight, nine = "a b c d e f g h", "a b c d e f g h i"  # four and five shingles: .8 to the bit
    return [*out, out[0], (2000, eight), (2001, nine), (2002, "A b  c\td e f g h"), (2003, None), (2004, ""), (2005, "one two"), (None, "one two"), (None, "x y")]


@pytest.mark.parametrize("frequent", [1 << 16, 0])
def test_keep_one_equals_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(shingles, "FREQUENT", frequent)
    rows = near_rows()
    got = [r.doc_id for r in shingles.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert sorted((g is None, g or 0) for g in got) == brute(rows)


def test_copy_beyond_two_bits_goes_in_the_pipeline(spark):
    import corpus_pipeline
    from newsloom.llm.simhash import fingerprints

    rng = random.Random(1)
    words = [f"v{rng.randrange(5000)}" for _ in range(300)]
    copies = [list(words) for _ in range(6)]
    for k, c in enumerate(copies):
        for at in (20 + k, 150 + k, 250 + k):
            c[at] = "changed"
    rows = [(k, " ".join(c)) for k, c in enumerate([words, *copies])]
    fps = fingerprints([t.encode() for _, t in rows], 3)
    assert max(np.bitwise_count(fps[0] ^ fps[1:])) > 2
    assert [r.doc_id for r in corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, COLUMNS), "").collect()] == [0]


def test_pairs_of_a_posting_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    token, n, row = np.sort(rng.integers(0, 6, 80)), rng.integers(50, 100, 80), rng.permutation(80)
    label = np.where(token == 0, 7, rng.integers(0, 3, 80))
    order = np.lexsort((row, n, token))
    token, n, row, label = token[order], n[order], row[order], label[order]
    want = {}
    for i in range(80):
        for j in range(i):
            if token[i] == token[j] and label[i] != label[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]):
                key = tuple(sorted((row[i], row[j])))
                want[key] = want.get(key, 0) + 1
    monkeypatch.setattr(shingles, "PAIRS", 20)
    got = {}
    bits = np.zeros((80, shingles.PARITY), np.int64)
    for a, b, shared in shingles.cross_pairs(token, row, n, label, bits):
        for x, y, s in zip(a, b, shared):
            got[x, y] = got.get((x, y), 0) + s
    assert got == want
    assert (shingles.mixed_entries(token, label) == (token != 0)).all()
    for turn in (0, 1):
        stars = list(zip(*shingles.star_pairs(token, row, n, label, rng.integers(1, 1000, 80), turn)))
        assert len(stars) > 10 and all(tuple(sorted(pair)) in want for pair in stars)


def test_parity_bits_bound_from_above():
    rng = np.random.default_rng(6)
    for size in (5, 60, 2000):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        for changed in (0, size // 20, size // 9, size // 5, size // 2):
            other = base.copy()
            other[:changed] = rng.integers(0, 1 << 62, changed).astype(np.uint64)
            a, b = np.unique(base), np.unique(other)
            bits = np.stack([shingles.parity_bits(a), shingles.parity_bits(b)])
            able = shingles.able_to_link(np.array([len(a), len(b)]), bits, np.array([0]), np.array([1]))[0]
            assert able or not shingles.linked(a, b)
    assert not able or size == 2000


def test_a_group_of_near_copies_costs_no_square_of_pairs(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(150):
        own = list(base)
        own[rng.randrange(200)] = f"own{k}"
        rows.append((k, " ".join(own)))
    met = []
    verified = shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, *a: met.append(pairs.count()) or verified(pairs, *a))
    assert [r.doc_id for r in shingles.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()] == [0]
    assert sum(met) < 8 * 150


def test_names_in_use_inside_are_kept(spark):
    df = spark.createDataFrame([(1, "a b c d e f", -1, -2), (2, "a b c d e f", -3, -4), (3, "other words here", -5, -6)], "doc_id long, text string, `row` int, __order int")
    kept = shingles.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", -1, -2), (3, "other words here", -5, -6)]


def test_empty_and_odd(spark, odd_docs, no_docs):
    assert shingles.keep_one(no_docs).count() == 0
    kept = shingles.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # 3, 4 and 5 have no words; the two rows of 1 are copies, and 2 is one but for case
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == [(False, k) for k in (1, 3, 6, 7, 8)] + [(True, 0)]
