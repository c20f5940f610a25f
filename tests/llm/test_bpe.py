import functools
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from newsloom.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@functools.cache
def reference():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def truth(text):
    return reference().encode_ordinary(text)


def encoded(encoder, texts):
    ids, edges = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]


def test_odd_rows_encode_as_tiktoken_and_decode_to_the_text(odd_docs):
    got = bpe.digests(bpe.round_trip(odd_docs, RANKS, PATTERN)).collect()
    want = sorted(
        (r.doc_id or -1, len(ids := truth(r.text or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in odd_docs.collect()
    )
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_two_stages_equal_one(odd_docs):
    one = bpe.round_trip(odd_docs, RANKS, PATTERN).collect()
    two = bpe.decode(bpe.encode(odd_docs, RANKS, PATTERN), RANKS).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_empty_table(no_docs):
    assert bpe.round_trip(no_docs, RANKS, PATTERN).count() == 0


def test_random_unicode_and_runs_equal_tiktoken():
    rng = random.Random(5)
    pools = ["ab", " \n\t\r ", "aA1'sS.!?", "éüß漢字🙂́", "".join(map(chr, range(0x20, 0x17F))), "".join(chr(c) for c in range(0x370, 0x2FFF)), "".join(chr(c) for c in range(0x10000, 0x20000, 7))]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [u * n for u in ("a", "ab", "aab", "-", "= ", "ha", "\n", " \n") for n in range(1, 40)]
    encoder = bpe.PieceEncoder(*bpe.bpe_from_ranks(RANKS), bpe.definition(RANKS, PATTERN), pieces=500)
    got = [x for lo in range(0, len(texts), 100) for x in encoded(encoder, texts[lo : lo + 100])]
    assert got == [truth(t) for t in texts]


def test_offsets_map_tokens_to_characters():
    text = "né 漢🙂 fin"
    ids = np.array(truth(text), np.int64)
    chars, inside = bpe.char_offsets(ids, RANKS)
    at = 0
    table = {i: b for b, i in bpe.read_ranks(RANKS).items()}
    for k, i in enumerate(ids):
        whole = text.encode()[:at].decode("utf-8", "ignore")
        assert chars[k] == len(whole) - (0 if not inside[k] else 0)
        assert inside[k] == (len(whole.encode()) != at)
        at += len(table[int(i)])


def test_unpack_ids(spark, odd_docs):
    row = bpe.encode(odd_docs.where("doc_id = 7"), RANKS, PATTERN).select(bpe.unpack_ids("ids").alias("a"), "ids").first()
    assert row.a == np.frombuffer(bytes(row.ids), "<u4").tolist()


def test_json_tokenizer_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(6)
    pools = ["ab", " \n\t\r ", "aA1'sS.!?", "éüß漢字🙂́", "".join(map(chr, range(0x20, 0x52F))), "".join(chr(c) for c in range(0x530, 0x2FFF))]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a<|endoftext|>b", "", "x <|endoftext|>  <|endoftext|>\0y", "<|endoftext|>" * 3]
    encoder = bpe.PieceEncoder(*bpe.bpe_from_json(path), pieces=300)
    plain = Tokenizer.from_file(path)
    assert encoded(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_pair_of_bytes_is_cut_where_the_pattern_allows():
    """All pairs and triples of characters of each class, and every character below U+0530 beside each class."""
    pool = "aZ7,'\"- \t\n\0\x1c\x7fé\u00a0\u2003漢"
    texts = ["".join(t) for n in (2, 3, 4) for t in itertools.product(pool, repeat=n)] + [f"{a}{chr(c)}{b}" for c in range(0x530) for a, b in (("a", "1"), ("1", "a"), (".", " "), (" ", "."), ("'", "s"))]
    encoder = bpe.rank_encoder(RANKS, PATTERN)
    got = [x for lo in range(0, len(texts), 5000) for x in encoded(encoder, texts[lo : lo + 5000])]
    assert got == [truth(t) for t in texts]


def test_long_pieces_and_a_full_memory(spark):
    texts = ["x" * n for n in (1, 127, 128, 129, 3000)] + ["漢" * 500 + " word"] * 2 + [f"w{k}" for k in range(300)]
    encoder = bpe.PieceEncoder(*bpe.bpe_from_ranks(RANKS), bpe.definition(RANKS, PATTERN), pieces=20)
    for _ in range(3):
        assert encoded(encoder, texts) == [truth(t) for t in texts]
    assert encoded(encoder, [None, "a", None]) == [[], truth("a"), []]
