"""Text normalizers, counts, hashes and phrase tests.

Three normalizers exist and differ on purpose: ``tidy_whitespace`` keeps line
structure, ``fold_title`` and ``fold_content`` serve duplicate detection, and
``fold_text`` serves relevance.  Each has a native form and, with
``exact=True``, an Arrow form for entity unescaping, Unicode composition and
full case folding, which Spark does not have.  On text without entities,
compatibility characters or exotic case both agree.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space left after control characters went: the union of what Java and Python call space.
SPACE = r"[\n\t\p{Z}]"
#: Runs of space that are not one plain blank: what there is to replace, as most runs are one.
UNEVEN = r"(?:[\n\t\p{Z}&&[^ ]][\n\t\p{Z}]*| [\n\t\p{Z}]+)"
#: A word character as this engine counts words.
WORD_CHAR = r"[\p{L}\p{N}_]"
DASHES, SINGLE_QUOTES, DOUBLE_QUOTES = "‐‑‒–—−", "‘’‚‛", "“”„‟"


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape_compat(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", html.unescape(x)), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def casefold(text: Column, exact: bool = False) -> Column:
    return _casefold(text) if exact else F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def drop_controls(text: Column) -> Column:
    """Without category C, but for newline and tab."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, UNEVEN, " "))


def tidy_whitespace(text: Column, exact: bool = False) -> Column:
    """Runs of spaces to one, three or more newlines to two, then every line and the whole trimmed. Null stays null."""
    text = drop_controls(_compose(text) if exact else text)
    text = F.regexp_replace(text, r"(?m)^[ \t]+$", "")
    text = F.regexp_replace(text, r"\t[ \t]*| [ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return trim_space(F.array_join(F.transform(F.split(text, "\n"), trim_space), "\n"))


def fold_unicode(text: Column, straighten: bool = True, exact: bool = False) -> Column:
    """One line, controls gone; with ``straighten`` dashes and curly quotes become ASCII. Null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    if exact:
        text = _unescape_compat(text)
    if straighten:
        text = F.translate(text, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return collapse(drop_controls(text))


def fold_title(title: Column, exact: bool = False) -> Column:
    return collapse(F.regexp_replace(casefold(fold_unicode(title, exact=exact), exact), r"[^\p{L}\p{N}_\s]", " "))


def fold_content(text: Column, paragraphs: Column | None = None, exact: bool = False) -> Column:
    """Of the text, or of the paragraphs if there is none."""
    raw = F.nullif(text, F.lit(""))
    if paragraphs is not None:
        raw = F.coalesce(raw, F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n"))
    return casefold(fold_unicode(raw, exact=exact), exact)


def fold_text(text: Column, exact: bool = False) -> Column:
    return casefold(fold_unicode(text, straighten=False, exact=exact), exact)


def fold_phrase(phrase: str) -> str:
    """``fold_text`` of a configured phrase, on the driver."""
    text = unicodedata.normalize("NFKC", html.unescape(phrase))
    text = "".join(c for c in text if c in "\n\t " or unicodedata.category(c)[0] != "C")
    return " ".join(text.split()).casefold()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CHAR + "+")), F.lit(0))


def reading_minutes(words: Column, per_minute: int = 225) -> Column:
    return F.when(words > 0, F.round(words / float(per_minute), 1)).otherwise(F.lit(0.0))


def tokens(text: Column) -> Column:
    """Distinct words, as an array."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD_CHAR}+)"), 1))


def content_tokens(text: Column) -> Column:
    """``tokens(fold_content(text))`` by less work: even blanks do not matter to words, nor do straight quotes but beside a capital sigma, whose lower case follows from what is around it."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit("Σ")), fold_unicode(text)).otherwise(drop_controls(text))
    return tokens(casefold(text))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / (F.size(left) + F.size(right) - both)).otherwise(F.lit(0.0))


def quote_regex(text: str) -> str:
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in text)


class Phrases:
    """Phrase tests of a folded text, each distinct phrase tested once a row; see ``with_phrases``."""

    def __init__(self, tests: dict[str, Column] | None = None):
        self.asked, self.tests = {}, tests

    def has(self, needle: str) -> Column:
        self.asked.setdefault(needle)
        return F.lit(False) if self.tests is None else self.tests[needle]


def with_phrases(df: DataFrame, column: str, *uses: Callable[[Phrases], object]) -> tuple[DataFrame, Phrases]:
    """The rows with helper columns, and the tests that ``uses`` need in place of the text.

    Phrases of one word are looked up among the words that the text and the phrases share, found in one pass; others are
    searched, each once. Helper columns begin with ``_phrase``.
    """
    asked = Phrases()
    for use in uses:
        use(asked)
    words = [n for n in asked.asked if all(c == "_" or unicodedata.category(c)[0] in "LN" for c in n)]
    tests, made = {}, {}
    if words:
        spoken = F.regexp_extract_all(F.col(column), F.lit(f"({WORD_CHAR}+)"), 1)
        made["_phrase_words"] = F.array_intersect(spoken, F.array(*[F.lit(w) for w in words]))
        tests |= {w: F.coalesce(F.array_contains("_phrase_words", w), F.lit(False)) for w in words}
    for k, needle in enumerate(n for n in asked.asked if n not in tests):
        made[f"_phrase_{k}"] = has_phrase(F.col(column), needle)
        tests[needle] = F.col(f"_phrase_{k}")
    return df.select("*", *[c.alias(n) for n, c in made.items()]), Phrases(tests)


def has_phrase(text: Column | Phrases, phrase: str, blank: bool = False) -> Column:
    """The folded phrase stands in folded text with no word character at either side; of a blank phrase the answer is given."""
    needle = fold_phrase(phrase)
    if not needle:
        return F.lit(blank)
    if isinstance(text, Phrases):
        return text.has(needle)
    return F.coalesce(text.rlike(f"(?<!{WORD_CHAR}){quote_regex(needle)}(?!{WORD_CHAR})"), F.lit(False))


def sha(text: Column) -> Column:
    """Hex SHA-256 of trimmed text; null if nothing is left."""
    bare = trim_space(text)
    return F.when(F.length(bare) > 0, F.sha2(bare, 256))


def stable_hash(text: Column) -> Column:
    """Of the text on one line, in lower case; null and empty text hash as the empty string."""
    return F.sha2(F.lower(trim_space(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " "))), 256)


def first_of_each(items: Column, key) -> Column:
    """Items whose key is not blank and did not occur before, in order. ``key`` maps a Column to a Column."""
    held = F.array(F.struct(items.alias("items"), F.transform(items, key).alias("keys")))  # one element: its fields are computed once
    new = lambda s, i: (F.coalesce(F.length(F.get(s["keys"], i)), F.lit(0)) > 0) & (F.array_position(s["keys"], F.get(s["keys"], i)) == i + 1)
    return F.get(F.transform(held, lambda s: F.filter(s["items"], lambda x, i: new(s, i))), F.lit(0))


def distinct_in_order(items: Column) -> Column:
    """First spelling of each item, trimmed; case does not count."""
    return F.transform(first_of_each(items, lambda x: F.lower(trim_space(x))), trim_space)


def distinct_paragraphs(items: Column) -> Column:
    return F.transform(first_of_each(items, lambda x: F.lower(collapse(x))), trim_space)


def non_empty(items: Column, least: int = 1) -> Column:
    return F.filter(items, lambda x: F.length(trim_space(x)) >= least)


def _hash60(text: Column) -> Column:
    """The first 15 hex digits of SHA-256, as a long: any engine can compute it."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def minhash(items: Column, size: int = 16) -> Column:
    """The least hash of the items under each of ``size`` seeds; null of no items. Equal places of two of them estimate the Jaccard."""
    one = lambda seed: F.array_min(F.transform(items, lambda x: _hash60(F.concat(F.lit(f"{seed}:"), x))))
    return F.when(F.size(items) > 0, F.array(*[one(k) for k in range(size)]))


def simhash(items: Column, bits: int = 60) -> Column:
    """A bit is one if it is set in over half of the items' hashes; zero of no items."""
    hashes = F.transform(items, _hash60)
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
    return sum((F.when(ones(b) * 2 > F.size(items), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(bits)), F.lit(0).cast("long"))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of each lower-case word, padded by two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), 1)
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def truncated(text: Column, most: int = 12_000) -> Column:
    return F.coalesce(F.substring(text, 1, most), F.lit(""))
