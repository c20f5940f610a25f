"""Similarity of two texts. Algorithms are callables (Column, Column) -> Column and can be replaced."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import jaccard, tokens

Algorithm = Callable[[Column, Column], Column]
#: Shares of token and sequence similarity in the hybrid.
TOKEN_SHARE, SEQUENCE_SHARE = 0.55, 0.45


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp on characters; the order of arguments matters; 0 if either is empty. Quadratic: prune before."""

    def one(a, b):
        if not a or not b:
            return 0.0
        return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio_from(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio where it can reach ``least``, else -1: by length, then by shared characters, both bounds from above."""

    def one(a, b, t):
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        made = SequenceMatcher(None, a, b, autojunk=False)
        return -1.0 if made.real_quick_ratio() < t or made.quick_ratio() < t else made.ratio()

    return pd.Series([one(a, b, t) for a, b, t in zip(left, right, least)], dtype="float64")


#: Cells of a comparison under which the plain form is quicker; the multiplier of rolling hashes, and its inverse, modulo 2**64.
_PLAIN, _BASE = 20_000, 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)


def _plain_matches(a: str, b: str) -> int:
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def _hashes(text: str, powers: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((points ^ (points >> np.uint64(29))) * powers[: len(points)], dtype=np.uint64)))


def sequence_matches(a: str, b: str) -> int:
    """Characters that ``SequenceMatcher`` matches without its heuristics: long pieces are found by rolling hashes and verified.

    The longest common piece that begins first in ``a``, then in ``b``, is taken, and so on to its left and to its right.
    """
    if len(a) * len(b) <= _PLAIN:
        return _plain_matches(a, b)
    most = max(len(a), len(b)) + 1
    powers, undo = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(most, x, np.uint64))), dtype=np.uint64) for x in (_BASE, _UNDO))
    ha, hb = _hashes(a, powers), _hashes(b, powers)
    windows = lambda h, lo, hi, n: (h[lo + n : hi + 1] - h[lo : hi + 1 - n]) * undo[lo : hi + 1 - n]

    def first(alo, ahi, blo, bhi, n, where=False):
        """Whether a piece of size n of ``a`` is in ``b`` too; where the first begins."""
        mine, theirs = windows(ha, alo, ahi, n), np.sort(windows(hb, blo, bhi, n))
        asked = mine if where else np.sort(mine)  # look-ups in order are quicker
        found = theirs[np.minimum(np.searchsorted(theirs, asked), len(theirs) - 1)] == asked
        return int(found.argmax()) if where else bool(found.any())

    total, stack = 0, [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while stack:
        alo, ahi, blo, bhi, above = stack.pop()
        if (ahi - alo) * (bhi - blo) <= _PLAIN:
            total += _plain_matches(a[alo:ahi], b[blo:bhi]) if ahi > alo and bhi > blo else 0
            continue
        # of size low there is one, of size high none: no piece is longer than the one beside it, which was found before
        low, high = 0, min(ahi - alo, bhi - blo, above) + 1
        size = high - 1 if high <= 32 else 16
        while high - low > 1:
            if first(alo, ahi, blo, bhi, size):
                low, size = size, min(size * 4, (size + high) // 2)
            else:
                high, size = size, (low + size) // 2
        if not low:
            continue
        at = first(alo, ahi, blo, bhi, low, where=True)
        j = b.find(a[alo + at : alo + at + low], blo, bhi)
        if j < 0:  # hashes that agree by chance
            total += _plain_matches(a[alo:ahi], b[blo:bhi])
            continue
        total += low
        stack += [(alo, alo + at, blo, j, low), (alo + at + low, ahi, j + low, bhi, low)]
    return total


def token_jaccard(left: Column, right: Column) -> Column:
    return jaccard(tokens(left), tokens(right))


def hybrid(left: Column, right: Column) -> Column:
    return TOKEN_SHARE * token_jaccard(left, right) + SEQUENCE_SHARE * sequence_ratio(left, right)


@dataclass(frozen=True)
class Similarity:
    """What titles and contents are compared by; results are clamped to 0..1."""

    title: Algorithm = sequence_ratio
    content: Algorithm = hybrid

    def titles(self, left: Column, right: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), self.title(left, right)))

    def contents(self, left: Column, right: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), self.content(left, right)))
