"""The pipeline against plain Python versions of its stages, on documents with rejects, near copies, secrets, repeats and nulls."""

import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from newsloom.llm import bpe, mixing, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, _score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice("river stone green hill the of and house bridge water light road".split()) + str(rng.randrange(30)) for _ in range(n)) + "."


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(60):
        text = prose(rng, rng.choice([12, 30, 120]))
        rows.append([k, text if k % 4 else " ".join(f"{w}$$$" for w in text.split()), "en", "abc"[k % 3]])
    for k in range(60, 80):  # near copies of documents that are kept, one word in a hundred and more changed
        words = rows[(k - 60) * 2 + 1][1].split()
        if len(words) > 100:
            words[rng.randrange(len(words))] = "changed"
        rows.append([k, " ".join(words), "en", "b"])
    rows += [[80, prose(rng, 40) + " password = hunter2secret " + prose(rng, 5), "en", "a"], [81, None, None, None], [82, "", "en", "a"], [80, rows[1][1], "en", "a"], [None, prose(rng, 20), "en", None]]
    return [(*r, len(r[1]) if r[1] is not None else None, -7, 0.5) for r in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path, rows = tmp_path_factory.mktemp("sf"), corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int("$$$" not in r[1])) for r in rows if r[0] is not None and r[1]]
    spark.createDataFrame(labels * 2, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each(rows):
    """The first of each group of links, by all pairs; ids that are null come last."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(r.text) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((r.doc_id is None, r.doc_id or 0, repr(r.text)))
    return sorted((min(g)[:2] for g in groups.values()))


def test_each_stage_equals_its_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, given = docs.columns, docs.collect()

    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == columns
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = []
    for r in given:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        if quality.predict(model, quality.features(raw, np.array([0, len(raw)])))[0] >= 0.5:
            want.append(repr(r))
    assert sorted(map(repr, kept.collect())) == sorted(want) and 0 < len(want) < len(given)
    assert sum("$$$" in w for w in want) <= 2

    kept.write.parquet(f"{sf}/q")
    docs = spark.read.parquet(f"{sf}/q")
    lone = corpus_pipeline.simhash_stage(spark, docs, sf)
    assert lone.columns == columns
    before, after = docs.collect(), lone.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == one_of_each(before) and len(after) < len(before)
    assert {repr(r) for r in after} <= {repr(r) for r in before}

    lone.write.parquet(f"{sf}/s")
    docs = spark.read.parquet(f"{sf}/s")
    clean = corpus_pipeline.secrets_stage(spark, docs, sf)
    assert clean.columns == columns
    rule = secrets.EntropyRule()
    want = []
    for r in docs.collect():
        text = None if r.text is None else secrets.redact_text(r.text, secrets.scan_text(r.text, rule), "[SECRET]")
        want.append((r.doc_id, text, None if text is None else len(text)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.n_chars)) for r in clean.collect())
    assert sum("[SECRET]" in (w[1] or "") for w in want) == 1

    clean.write.parquet(f"{sf}/c")
    docs = spark.read.parquet(f"{sf}/c")
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf)
    assert mixed.columns == columns
    before, after = docs.collect(), mixed.collect()
    times, sizes, taken = {}, {}, {}
    for r in after:
        times[repr(r)] = times.get(repr(r), 0) + 1
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text or ""))
    assert set(times) <= {repr(r) for r in before} and max(times.values()) <= 2
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, goal in zip(names, mixing.targets([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])):
        assert abs(taken.get(s, 0) - goal) <= 130  # a document at the edge
    assert all(r.text for r in before) or sum(not r.text for r in after) == sum(not r.text for r in before)

    mixed.write.parquet(f"{sf}/m")
    docs = spark.read.parquet(f"{sf}/m")
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    truth = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = np.array(truth.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    made = corpus_pipeline.bpe_stage(spark, docs, sf)
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in made.collect())

    # and all of them in a row
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in corpus_pipeline.run(spark, sf).collect())


def test_no_documents_and_no_labels(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents_pass_all_stages(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids <= {None, 1, 3, 6, 7, 8} and {3, 6} <= ids


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "secrets", "mixing", "bpe"]
