import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
CHANGE = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, note string, n_docs long"


def change(spark, *rows):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], CHANGE)


def totals(rollup):
    return sorted(map(repr, (tuple(r) for r in rollup.totals().collect())))


def test_signed_deltas_add_up_and_batches_count_once(spark):
    rollup = counts.TokenRollup(spark)
    assert totals(rollup) == []
    one = change(spark, ("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, None, "t1", None, None), ("insert", "b", "fr", "t1", 3, None))
    assert rollup.apply("one", one) and not rollup.apply("one", one)
    assert rollup.apply("two", change(spark, ("revise", "a", "en", "t1", 12, 10), ("delete", "b", "fr", "t1", 3, None)))
    want = sorted(map(repr, [("a", "en", "t1", 2, 17), (None, None, "t1", 1, 0)]))
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and not rollup.apply("two", one)
    assert rollup.apply("empty", one.limit(0)) and totals(rollup) == want


def test_a_batch_that_died_is_invisible(spark):
    rollup = counts.TokenRollup(spark)
    bad = change(spark, ("insert", "a", "en", "t1", 1, None), ("merge", "a", "en", "t1", 1, None))
    with pytest.raises(Exception, match="unknown op"):
        rollup.apply("x", bad)
    assert totals(rollup) == []
    assert rollup.apply("x", bad.where("op = 'insert'"))
    with pytest.raises(ValueError):
        rollup.apply("../x", bad)


def test_documents_end_at_token_counts(odd_docs, no_docs):
    tok = Tokenizer.from_file(PATH)
    want = {}
    for r in odd_docs.collect():
        key = (r.source, r.lang)
        n, t = want.get(key, (0, 0))
        want[key] = (n + 1, t + len(tok.encode(r.text or "", add_special_tokens=False).ids))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in counts.rollup_documents(odd_docs, PATH, "v").totals().collect()}
    assert got == want
    assert counts.rollup_documents(no_docs, PATH, "v").totals().count() == 0


def test_word_counts_go_with_token_counts(odd_docs):
    row = counts.count_tokens(odd_docs, PATH, "text", "doc_id").where(F.col("doc_id") == 5).first()
    assert (row.n_words, row.n_tokens > 0) == (0, True)


def test_a_crash_between_any_two_steps_of_compaction_changes_nothing(spark, monkeypatch):
    made = change(spark, ("insert", "a", "en", "t1", 10, None), ("insert", "b", "fr", "t1", 3, None))
    for stop in range(6):  # a rename, then four deletes
        rollup = counts.TokenRollup(spark)
        rollup.apply("one", made)
        rollup.apply("two", made)
        rollup.compact()
        rollup.apply("three", made)
        want, steps = totals(rollup), iter(range(100))
        assert want == sorted(map(repr, [("a", "en", "t1", 3, 30), ("b", "fr", "t1", 3, 9)]))

        def step(self, *args, what=None, at=stop, steps=steps):
            if next(steps) == at:
                raise KeyboardInterrupt
            return what(self, *args)

        put, delete = counts.TokenRollup._put, counts.TokenRollup._delete
        with monkeypatch.context() as m:
            m.setattr(counts.TokenRollup, "_put", lambda self, *a: step(self, *a, what=put))
            m.setattr(counts.TokenRollup, "_delete", lambda self, *a: step(self, *a, what=delete))
            try:
                rollup.compact()
                crashed = False
            except KeyboardInterrupt:
                crashed = True
        assert crashed == (stop < 5)
        again = counts.TokenRollup(spark, rollup.path)
        assert totals(again) == want
        assert not any(again.apply(x, made) for x in ("one", "two", "three")) and totals(again) == want
        assert again.compact() and totals(again) == want and again.apply("four", made)


def test_two_writers_of_one_batch_count_once(spark, monkeypatch):
    made = change(spark, ("insert", "a", "en", "t1", 10, None))
    rollup = counts.TokenRollup(spark)
    with monkeypatch.context() as m:  # the second writer has looked before the first committed
        m.setattr(counts.TokenRollup, "is_committed", lambda self, name: False)
        assert rollup.apply("x", made) and not rollup.apply("x", made)
        rollup.compact()
        rollup.apply("x", made)  # and here the first commit is folded already
    assert totals(rollup) == [repr(("a", "en", "t1", 1, 10))]
    rollup.compact()
    assert totals(rollup) == [repr(("a", "en", "t1", 1, 10))]


def test_two_compactions_at_once(spark, monkeypatch):
    made = change(spark, ("insert", "a", "en", "t1", 10, None))
    rollup = counts.TokenRollup(spark)
    rollup.apply("x", made)
    old = rollup._snapshot()
    assert rollup.compact()
    with monkeypatch.context() as m:
        m.setattr(counts.TokenRollup, "_snapshot", lambda self: old)
        m.setattr(counts.TokenRollup, "_live", lambda self, s: {})
        assert not rollup.compact()
    assert totals(rollup) == [repr(("a", "en", "t1", 1, 10))]


def test_carried_names_may_be_those_in_use(spark):
    rows = spark.createDataFrame([("a", "b c", 1)], "text string, _text string, c0 long")
    assert counts.count_tokens(rows, PATH, "_text", "c0", "text").collect() == [(1, "a", 2, 2)]
