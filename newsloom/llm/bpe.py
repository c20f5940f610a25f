"""Operator 1: byte-level BPE encoding and decoding.

Encoding runs the tokenizers library over Arrow batches.  A BPE model is built
from a rank file: every byte maps to one printable character (the byte table),
and every split of a token into two known tokens becomes a merge of that
token's rank.  Text is cut at places (``cuts``) that no match of the split
pattern crosses and beyond which no look-ahead sees, so a piece encodes alone
exactly as it does in its text.  The cuts are a few comparisons over the bytes
of a slice of an Arrow column, Arrow's own dictionary encoding finds the
distinct pieces of the slice, and only those meet Python: known ones are looked
up, new ones go to the library many at a time.  A piece that is one match by its
ASCII form goes to the BPE model at once, in the characters that stand for its
bytes; others pass the library's pre-tokenizer first.  The ids of all texts then
follow in one gather.  What a worker remembers is bounded (two generations).

A rank file defines merges by token, the library by pair: where overlapping
pairs spell the same token (runs such as ``aaa``), the two may choose
differently.  New pieces are therefore checked against tiktoken, whose ids are
the definition: as one text a batch, by halves where that differs.

Decoding looks ids up in the reversed byte table; text is assembled from bytes,
so a character split over tokens is whole again.  ``char_offsets`` maps token
boundaries to characters.

Defined cases: null text encodes as the empty text (no ids); an empty table
gives an empty table; repeated rows each give a row; a null doc_id is carried;
columns other than id and text are ignored.  Ids are carried packed, as
little-endian unsigned 32-bit integers (``unpack_ids`` gives an array column).
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, utf8_buffer

#: Bytes of text worked on at once, pieces of a generation, pieces handed over at once, and the longest piece that is remembered.
SLICE_BYTES, CACHE_PIECES, ASK, REMEMBERED = 4 << 20, 250_000, 5_000, 128


def byte_table() -> list[str]:
    """Byte -> character: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


@functools.lru_cache(maxsize=4)
def bpe_from_ranks(path: str):
    """(tokenizers.Tokenizer for a rank file, its bare model)."""
    ranks, table = read_ranks(path), byte_table()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(shown[a], shown[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    from tokenizers import pre_tokenizers

    vocab = {shown[t]: r for t, r in ranks.items()}
    made = _bare(vocab, merges)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made, _bare(vocab, merges)


def _bare(vocab: dict[str, int], merges: list[tuple[str, str]]):
    """A tokenizer of a model alone; it sees each word once, so it keeps none."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, models

    return Tokenizer(models.BPE(vocab=vocab, merges=merges, cache_capacity=0))


@functools.lru_cache(maxsize=4)
def definition(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def bpe_from_json(path: str):
    """(tokenizers.Tokenizer from its own file, its bare model); the strings of its added tokens are those tokens, as in a plain call."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    kept = json.loads(made.to_str())["model"]
    return made, _bare(kept["vocab"], [tuple(m) for m in kept["merges"]])


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    end = np.cumsum(size)
    return values[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)]


class _Generation:
    """Ids of pieces: a piece's place, and its run in one array."""

    def __init__(self):
        self.place, self.start, self.size, self.ids = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, pieces: list[bytes], size: np.ndarray, ids: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def runs(self, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(places, np.int64)
        return self.size[at], gather(self.ids, self.start[at], self.size[at])


#: Classes of bytes: white space, space, letters, digits, marks, the apostrophe, and others (controls, parts of wide characters).
_WHITE, _SPACE, _LETTER, _DIGIT, _MARKS, _QUOTE, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARKS
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = _DIGIT, _LETTER, _LETTER
_CLASS[0x09:0x0E], _CLASS[0x20], _CLASS[0x27] = _WHITE, _SPACE, _QUOTE
#: What a byte is for a space before it: the start of a character that is not white space (C2, E1, E2 and E3 may start one that is).
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True
#: Classes between which a match always ends: visible ASCII of two kinds, or visible ASCII before white space; a quote may begin a match with the letter after it, and is a mark among marks.
_APART = np.zeros((7, 7), bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARKS), (_DIGIT, _MARKS)):
    _APART[_a, _b] = _APART[_b, _a] = True
_APART[_LETTER, _QUOTE] = _APART[_DIGIT, _QUOTE] = _APART[_QUOTE, _DIGIT] = True
for _a in (_LETTER, _DIGIT, _MARKS, _QUOTE):
    _APART[_a, _WHITE] = _APART[_a, _SPACE] = True

#: A piece that is one match.
_ONE = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places between bytes at which a text may be cut (before the byte of that number)."""
    kind = _CLASS[raw]
    apart = _APART[kind[:-1], kind[1:]]
    space = np.flatnonzero((raw[:-1] == 0x20) & _SOLID[raw[1:]])
    return np.concatenate([np.flatnonzero(apart) + 1, space])


class PieceEncoder:
    """Ids of the texts of an Arrow column."""

    #: Stands between words that go to the library together: a character of one token, which only it spells.
    MARK = "\0"

    def __init__(self, tokenizer, model, exact=None, pieces: int = CACHE_PIECES):
        """``model``: the tokenizer's BPE model alone, for words in the characters of the byte table."""
        self.library, self.model, self.exact, self.most = tokenizer, model, exact, pieces
        self.young, self.old = _Generation(), _Generation()
        (self.mark,) = self._words(self.library, [self.MARK])
        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def _words(tokenizer, words: list[str]) -> np.ndarray:
        (made,) = tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)
        return np.array(made.ids, np.uint32)

    def _split(self, tokenizer, words: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words that do not hold the mark: one call."""
        marked = [mark] * (2 * len(words))
        marked[::2] = words
        ids = self._words(tokenizer, marked)
        inner = ids != self.mark
        return np.diff(np.flatnonzero(~inner), prepend=-1) - 1, ids[inner]

    def _settle(self, pieces: list[str], size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As the definition has it; ``pieces`` stand side by side as they would in a text."""
        if self.exact is None or np.array_equal(self.exact.encode_to_numpy("".join(pieces)), ids):
            return size, ids
        if len(pieces) == 1:
            ids = self.exact.encode_to_numpy(pieces[0])
            return np.array([len(ids)], np.int64), ids
        half = len(pieces) // 2
        cut = int(size[:half].sum())
        parts = [self._settle(pieces[:half], size[:half], ids[:cut]), self._settle(pieces[half:], size[half:], ids[cut:])]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _learn(self, new: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(pieces in an order of their own, sizes, ids). Pieces that begin with a space and a mark, digit or letter are checked side by side, others alone."""
        spaced, bare, rest, marked, mark = [], [], [], [], self.MARK.encode()
        for x in new:
            ((spaced if x[0] == 0x20 else bare) if _ONE.fullmatch(x) else marked if mark in x else rest).append(x)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for lo in range(0, len(spaced), ASK):
            words = b"\0".join(spaced[lo : lo + ASK]).decode()
            parts.append(self._settle(words.split("\0"), *self._split(self.model, words.replace(" ", "\u0120").split("\0"), "\u0100")))
        for lo in range(0, len(bare), ASK):
            words = b"\0".join(bare[lo : lo + ASK]).decode().split("\0")
            parts += self._one_by_one(words, *self._split(self.model, words, "\u0100"))
        for lo in range(0, len(rest), ASK):
            words = [x.decode("utf-8", "replace") for x in rest[lo : lo + ASK]]
            parts += self._one_by_one(words, *self._split(self.library, words, self.MARK))
        for x in marked:
            ids = self._words(self.library, [x.decode("utf-8", "replace")])
            parts += self._one_by_one([x.decode("utf-8", "replace")], np.array([len(ids)], np.int64), ids)
        return [*spaced, *bare, *rest, *marked], *(np.concatenate(x) for x in zip(*parts))

    def _one_by_one(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.exact is None:
            return [(size, ids)]
        at = np.concatenate([[0], np.cumsum(size)])
        return [self._settle(words[k : k + 1], size[k : k + 1], ids[at[k] : at[k + 1]]) for k in range(len(words))]

    def _runs(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size) of each distinct piece in an array of ids."""
        if len(self.young.place) > self.most:
            self.old, self.young = self.young, _Generation()
        known, older = self.young.place, self.old.place
        new = [x for x in pieces if x not in known]
        if back := [x for x in new if x in older]:
            self.young.add(back, *self.old.runs([older[x] for x in back]))
            new = [x for x in new if x not in older]
        if short := [x for x in new if len(x) <= REMEMBERED]:
            self.young.add(*self._learn(short))
        start, size, ids, spare = self.young.start, self.young.size, self.young.ids, {}
        if len(short) < len(new):  # long pieces, of which there are few, are not remembered
            long, more, their = self._learn([x for x in new if len(x) > REMEMBERED])
            spare = {x: len(start) + k for k, x in enumerate(long)}
            start, size, ids = np.concatenate([start, len(ids) + np.cumsum(more) - more]), np.concatenate([size, more]), np.concatenate([ids, their])
        at = np.fromiter((known[x] if x in known else spare[x] for x in pieces) if spare else map(known.__getitem__, pieces), np.int64, len(pieces))
        return start[at], size[at], ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 places at which each text's begin)."""
        raw, at = utf8_buffer(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        first = np.zeros(len(raw) + 1, bool)
        first[cuts(raw)] = True
        data = raw.tobytes() if self.added else b""
        for token in self.added:  # a text that spells an added token goes to the library whole
            hit = data.find(token)
            while hit >= 0:
                text = int(np.searchsorted(at, hit, "right"))
                first[at[text - 1] : at[text]] = False
                hit = data.find(token, int(at[text]))
        first[at] = True
        edges = np.flatnonzero(first)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        start, size, ids = self._runs(pieces.dictionary.to_pylist())
        which = pieces.indices.to_numpy()
        size = size[which]
        before = np.concatenate([[0], np.cumsum(size)])
        return gather(ids, start[which], size), before[np.searchsorted(edges, at)]


def packed(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column of runs of ids."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((4 * edges).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])


@functools.lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(*bpe_from_ranks(path), definition(path, pattern))


@functools.lru_cache(maxsize=4)
def json_encoder(path: str) -> PieceEncoder:
    """Of a file whose pre-tokenizer is the byte-level one."""
    return PieceEncoder(*bpe_from_json(path))


def encode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary) of every row's whole text."""
    kept = pick(df, id_col, text_col)
    id_type = kept.schema[0].dataType

    def run(batches):
        encoder = rank_encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), packed(*encoder.encode(part.column(1)))], names=[id_col, "ids"])

    return kept.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, ids binary")


@functools.lru_cache(maxsize=4)
def _id_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id: its bytes' length and place in one buffer, read off the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_table())}
    vocab = bpe_from_ranks(path)[0].get_vocab()
    tokens = [b""] * (max(vocab.values()) + 1)
    for shown, i in vocab.items():
        tokens[i] = bytes(back[c] for c in shown)
    size = np.array([len(t) for t in tokens], np.int64)
    return size, np.concatenate([[0], np.cumsum(size)[:-1]]), np.frombuffer(b"".join(tokens), np.uint8)


def decode_ids(ids: np.ndarray, path: str) -> np.ndarray:
    """Bytes of a run of ids, in one gather."""
    size, place, data = _id_table(path)
    return gather(data, place[ids], size[ids])


def char_offsets(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token the index of the character its first byte belongs to, and whether it starts inside one."""
    size, _, _ = _id_table(path)
    start = np.cumsum(size[ids]) - size[ids]
    inner = (decode_ids(ids, path) & 0xC0) == 0x80
    return (np.cumsum(~inner) - 1)[start], inner[start]


def _decoded(ids: np.ndarray, edge: np.ndarray, ranks: str) -> list[pa.Array]:
    """decoded, n_chars and n_split of runs of ids."""
    size, _, _ = _id_table(ranks)
    data = decode_ids(ids, ranks)
    inner = (data & 0xC0) == 0x80
    at = np.concatenate([[0], np.cumsum(size[ids])]).astype(np.int64)
    split = np.concatenate([[0], np.cumsum(inner[at[:-1]])])
    whole = np.concatenate([[0], np.cumsum(~inner)])
    cut = at[edge]
    texts = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)])
    return [texts, pa.array(np.diff(whole[cut]), pa.int64()), pa.array(np.diff(split[edge]), pa.int64())]


DECODED = ["decoded", "n_chars", "n_split"]


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode`` in one Arrow stage: ids cross to the JVM once, and a task needs one Python worker."""
    kept = pick(df, id_col, text_col)
    id_type = kept.schema[0].dataType

    def run(batches):
        encoder = rank_encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                made = encoder.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), packed(*made), *_decoded(*made, ranks)], names=[id_col, "ids", *DECODED])

    return kept.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, ids binary, decoded binary, n_chars long, n_split long")


def decode(df: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds to (id, ids): decoded binary, n_chars, and n_split, the tokens that start inside a character."""
    kept = pick(df, id_col, ids_col)
    id_type = kept.schema[0].dataType

    def run(batches):
        for batch in batches:
            for part in slices(batch, ids_col, SLICE_BYTES):
                raw, at = utf8_buffer(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_decoded(raw.view("<u4"), at // 4, ranks)], names=[id_col, ids_col, *DECODED])

    return kept.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, `{ids_col}` binary, decoded binary, n_chars long, n_split long")


def unpack_ids(ids: Column) -> Column:
    """Packed ids as an array<bigint>, built in."""
    text = F.hex(ids)
    at = lambda i, k: F.substring(text, i * 8 + 1 + 2 * k, F.lit(2))
    one = lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("long")
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(
        F.col(f"`{id_col}`"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_chars",
        "n_split",
    )
