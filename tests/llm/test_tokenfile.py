import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 20])
def test_packing_round_trips_with_random_access(bits):
    rng = np.random.default_rng(bits)
    runs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 1, 7, 300)]
    block = tokenfile.make_block(bits, 3, 9, np.array([5, tokenfile.NO_ID, 7, 8]), np.array([0, 1, 7, 300]), np.concatenate(runs)) + tokenfile.END
    block += tokenfile.make_index([0], [9]) + tokenfile.END
    ((at, b, file, n_docs, n_ids, first),) = tokenfile.blocks(block)
    assert (at, b, file, n_docs, n_ids, first) == (0, bits, 3, 4, 308, 9)
    docs, sizes, ids = tokenfile.read_block(block, 0)
    whole = np.concatenate(runs)
    assert docs.tolist() == [5, tokenfile.NO_ID, 7, 8] and sizes.tolist() == [0, 1, 7, 300] and (ids == whole).all()
    for lo, n in ((0, 308), (1, 5), (8, 16), (300, 8), (307, 1)):
        assert (tokenfile.read_range(block, 0, lo, n) == whole[lo : lo + n]).all()
        assert (tokenfile.read_ids(block, 9 + lo, n) == whole[lo : lo + n]).all()


def test_bits():
    assert [tokenfile.bits_for(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_files_equal_the_library(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 100)
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 16)
    tok = Tokenizer.from_file(PATH)
    got = sorted(tokenfile.write_and_digest(odd_docs, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    text, start = {r.doc_id: r.text or "" for r in odd_docs.collect()}, 0
    for r in got:
        ids = [*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfile.write_and_digest(no_docs, PATH).count() == 0


def test_damaged_block():
    block = bytearray(tokenfile.make_block(16, 0, 0, np.array([1]), np.array([3]), np.arange(3, dtype=np.uint32)) + tokenfile.END + tokenfile.make_index([0], [0]) + tokenfile.END)
    assert len(list(tokenfile.blocks(bytes(block)))) == 1 and not list(tokenfile.blocks(b""))
    for at in (0, len(block) - 1, len(block) - 30):
        bad = block.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(tokenfile.blocks(bytes(bad)))


def test_any_place_of_a_file_of_many_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 16)
    docs = spark.createDataFrame([(k, f"word{k} other words " * (k % 5)) for k in range(40)], "doc_id long, text string")
    tokenfile.write(docs, PATH, f"file://{tmp_path}/out")
    tok = Tokenizer.from_file(PATH)
    want = [i for r in docs.collect() for i in [*tok.encode(r.text, add_special_tokens=False).ids, 0]]
    (file,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    data = file.read_bytes()
    assert len(list(tokenfile.blocks(data))) > 5
    for lo, n in ((0, len(want)), (15, 3), (17, 90), (len(want) - 1, 1)):
        assert tokenfile.read_ids(data, lo, n).tolist() == want[lo : lo + n]
