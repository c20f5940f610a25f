import random

import numpy as np
import pytest
import xxhash

from newsloom.llm import simhash


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items):
    """items: (id, fp); id may be None."""
    label = list(range(len(items)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    groups = {}
    for k, (i, _) in enumerate(items):
        groups.setdefault(root(k), []).append(i)
    return [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(items))]


def test_odd_rows_equal_brute_force(odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted(repr((r.doc_id, f"{f:016x}", c)) for r, f, c in zip(rows, fps, plain_components([(r.doc_id, f) for r, f in zip(rows, fps)])))
    assert sorted(repr(tuple(r)) for r in simhash.digests(simhash.dedup(odd_docs)).collect()) == want
    assert simhash.dedup(no_docs).count() == 0


def test_very_long_texts_are_voted_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "HASHES", 8)
    texts = [" ".join(random.Random(k).choices("a b c d e".split(), k=k)) for k in (0, 1, 2, 3, 7, 9, 10, 11, 40, 200)]
    assert simhash.fingerprints([t.encode() for t in texts], 3).tolist() == [plain_fingerprint(t) for t in texts]


def test_links_equal_all_pairs_on_clustered_fingerprints(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = set()
    for s in seeds:
        for _ in range(60):
            f = s
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    chain = rng.getrandbits(64)
    for k in range(30):
        chain ^= 3 << (2 * k)
        fps.add(chain)
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.connected(simhash.fingerprint_edges(nodes)).collect()}
    got = {}
    for k, f in enumerate(fps):
        got.setdefault(roots.get(signed(f), f"own{k}"), set()).add(k)
    want = {}
    for k, c in enumerate(plain_components(list(enumerate(fps)))):
        want.setdefault(c, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("n", [2, 10, 64, 65, 3000])
def test_posting_edges(n):
    rng = np.random.default_rng(n)
    rest = np.unique(rng.integers(0, 1 << 16, n).astype(np.uint64))
    label = simhash.posting_edges(rest, rest, 2)
    near = np.bitwise_count(rest[:, None] ^ rest[None, :]) <= 2
    for i in range(min(len(rest), 200)):
        assert (label[near[i]] == label[i]).all()
    # labels are members of their own parts
    assert (label[label] == label).all()


def test_shared_bytes():
    a, b = np.array([0x1122334455667788, 0], np.uint64), np.array([0x1122334455667788, 0xFF00000000000001], np.uint64)
    assert simhash.shared_bytes(a, b).tolist() == [8, 6]


def test_a_third_of_all_rows_with_one_fingerprint(spark, monkeypatch):
    from newsloom.operators import components

    monkeypatch.setattr(components, "HOT_LEAST", 5)
    rows = [(k, "same words in all of these" if k % 3 == 0 else f"text {k} of its own words {k * k}") for k in range(300, 600)]
    got = {r.doc_id: r.component_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    assert got == {i: c for (i, _), c in zip(rows, plain_components([(i, f) for (i, _), f in zip(rows, fps)]))}
