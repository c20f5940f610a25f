import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 10, 10], [3, 1, 2]) == [20.0, 45 * 0 + 25 / 3, 25 * 2 / 3]
    assert mixing.targets([0, 10], [3, 1]) == [0.0, 15.0]
    assert mixing.targets([], []) == []


def test_tree_deals_all_draws_evenly():
    draws = np.array([1000, 17, 0, 333])
    out = mixing.split_quotas(draws, 7, 3)
    assert (out.sum(1) == draws).all() and out.min() >= 0
    assert out.sum(0).max() - out.sum(0).min() <= 3
    assert (out == mixing.split_quotas(draws, 7, 3)).all()


@pytest.mark.parametrize("block", [3, 4096])
def test_quotas_are_exact_and_no_document_exceeds_twice_its_size(spark, odd_docs, block):
    rows = mixing.mix(odd_docs, shards=4, block=block).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        covered = np.zeros(r["size"], int)
        for p in r.pieces:
            assert 0 <= p.start < p.end <= r["size"] and 0 <= p.shard < 4
            covered[p.start : p.end] += 1
        assert covered.sum() == r.taken and (r["size"] == 0 or covered.max() - covered.min() <= 1)
        by.setdefault((r.source_size, r.target), 0)
        by[(r.source_size, r.target)] += r.taken
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 1
    sizes = {}
    for d in odd_docs.collect():
        sizes[d.source] = sizes.get(d.source, 0) + len(WORD.findall(d.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    assert {round(t, 6) for _, t in by} == {round(t, 6) for t in want}


def test_reruns_agree(odd_docs):
    key = lambda df: sorted((repr(r.doc_id), r["size"], r.taken, repr(r.pieces)) for r in df.collect())
    assert key(mixing.mix(odd_docs)) == key(mixing.mix(odd_docs.repartition(3)))


def test_empty_table(no_docs):
    assert mixing.mix(no_docs).count() == 0


def test_documents_are_whole_and_near_their_targets(spark, odd_docs):
    made = mixing.draw_documents(odd_docs, block=3)
    assert made.columns == odd_docs.columns
    rows, given = made.collect(), {r.text for r in odd_docs.collect()}
    assert {r.text for r in rows} <= given
    assert {3, 4, 5} <= {r.doc_id for r in rows}  # without words: kept once
    docs = spark.createDataFrame([(k, "a b c d e " * (k % 7), "xyz"[k % 3], -7) for k in range(600)], "doc_id long, text string, source string, `row` int")
    drawn = mixing.draw_documents(docs, block=50)
    assert drawn.columns == docs.columns and {r.row for r in drawn.collect()} == {-7}
    words = {}
    for r in drawn.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for r in mixing.mix(docs, block=50).selectExpr("source_size", "target").distinct().collect():
        assert min(abs(n - r.target) for n in words.values()) < 0.05 * r.target


def test_permutation_is_exact_and_keyed(spark):
    for n in (1, 2, 3, 50, 257):
        orders = [[mixing.position(b, n, seed, 4) for b in range(n)] for seed in (1, 2)]
        assert all(sorted(x) == list(range(n)) for x in orders) and (n < 50 or orders[0] != orders[1])
        made = spark.range(n).select(mixing.position_of(F.col("id"), F.lit(n).cast("long"), 1, F.lit(4).cast("long")).alias("p"))
        assert [r.p for r in made.collect()] == orders[0]
    steps = np.diff([mixing.position(b, 257, 3, 0) for b in range(257)]) % 257
    assert len(set(steps.tolist())) > 100  # no walk of equal steps


def test_taken_is_what_a_replay_of_the_draws_takes(spark):
    """Brute force: sequences of words, blocks, the permutation, and the tree's runs of draws, shard by shard."""
    rng = np.random.default_rng(7)
    docs = [(k, " ".join(["w"] * int(rng.integers(0, 40))), [None, "a", "b"][int(rng.integers(0, 3))]) for k in range(60)] + [(7, "x y z", "a")] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    seed, shards, block = 9, 5, 7
    got = mixing.mix(df, seed=seed, shards=shards, block=block).collect()
    # places of documents in their sources follow from the pieces of a full pass or from sizes: rebuild them from the hashes
    hashed = df.select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")).collect()
    rows, seen = [], {}
    for r in hashed:
        n = seen[r.h] = seen.get(r.h, -1) + 1
        rows.append((r.source, r.h if n == 0 else mixing._hash(r.h, n), r.doc_id, len(r.text.split())))
    names = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[3] for r in rows if r[0] == s) for s in names]
    goal = mixing.targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])
    plan = mixing.plan(list(zip(names, sizes)), seed, shards, 1.5, 2, (3, 1, 2), block)
    taken = []
    for k, s in enumerate(names):
        own = sorted(r[1:] for r in rows if r[0] == s)
        owner = [i for i, r in enumerate(own) for _ in range(r[2])]
        n = -(-len(owner) // block)
        order = sorted(range(n), key=lambda b: mixing.position(b, n, seed, k))
        left, draws = round(goal[k]), []
        for d in range(plan[k]["upto"][-1]):
            words = owner[order[d % n] * block : (order[d % n] + 1) * block][: max(left, 0)]
            left -= len(words)
            draws.append(words)
        assert left == 0
        shares = np.diff([0, *plan[k]["upto"]])
        assert shares.sum() == len(draws) and len(shares) == shards
        count = np.bincount([i for shard in np.split(np.arange(len(draws)), plan[k]["upto"][:-1]) for d in shard for i in draws[d]], minlength=len(own))
        taken += [(r[1], r[2], int(c)) for r, c in zip(own, count)]
    assert sorted((r.doc_id, r["size"], r.taken) for r in got) == sorted(taken)
    other = mixing.mix(df, seed=seed + 1, shards=shards, block=block).collect()
    assert sorted((r.doc_id, r.taken) for r in other) != sorted((r.doc_id, r.taken) for r in got)
    by_shard = {}
    for r in got:
        for p in r.pieces:
            by_shard[p.shard] = by_shard.get(p.shard, 0) + p.end - p.start
    assert len(by_shard) == shards


def test_repeated_rows_are_spread_and_rerun_alike(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 500 + [(k, "d e", "t") for k in range(50)], "doc_id long, text string, source string")
    spread = mixing._spread(df.select(F.col("doc_id").alias("doc"), F.col("source"), F.lit(3).alias("size"), F.xxhash64("doc_id", "text").alias("h"), F.spark_partition_id().alias("part")))
    assert spread.select("h").distinct().count() == 51 + 499
    key = lambda d: sorted((r.doc_id, r.taken) for r in mixing.mix(d, block=16).collect())
    assert key(df.repartition(5)) == key(df.coalesce(1))


def test_quotas_beyond_the_samplers_range():
    draws = np.array([3 * 10**9, 10**9, 17])
    out = mixing.split_quotas(draws, 4, 1)
    assert (out.sum(1) == draws).all() and out.min() >= 0 and out.sum(0).max() - out.sum(0).min() <= 2
    assert abs(out[0] / draws[0] - 0.25).max() < 1e-3
