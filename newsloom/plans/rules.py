"""Boolean rules compiled to Columns.

    or    := and ("OR" and)*
    and   := not (["AND"] not)*     where AND may be left out before NOT only
    not   := "NOT" not | leaf
    leaf  := "(" or ")" | "quoted words" | word

A rule is read once, on the driver; rows are tested by Catalyst.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import has_phrase

_LEXEME = re.compile(r"[()]|\"[^\"]+\"|\b(?:AND|OR|NOT)\b|[A-Za-z0-9_-]+", re.I)


class RuleError(ValueError):
    """The expression does not parse."""


def lex(expression: str) -> list[str]:
    found, at = [], 0
    for m in _LEXEME.finditer(expression):
        if expression[at : m.start()].strip():
            raise RuleError(f"invalid syntax at {at}: {expression}")
        found.append(m[0])
        at = m.end()
    if expression[at:].strip():
        raise RuleError(f"invalid syntax at {at}: {expression}")
    if not found:
        raise RuleError("empty expression")
    return found


def parse(expression: str):
    """Nested tuples: ("or"|"and", a, b), ("not", a), ("phrase", text)."""
    tokens = lex(expression)[::-1]

    def ahead(*words: str) -> bool:
        return bool(tokens) and tokens[-1].upper() in words

    def take() -> str:
        if not tokens:
            raise RuleError("unexpected end of expression")
        return tokens.pop()

    def either():
        left = both()
        while ahead("OR"):
            take()
            left = ("or", left, both())
        return left

    def both():
        left = negated()
        while ahead("AND", "NOT"):
            if ahead("AND"):
                take()
            left = ("and", left, negated())
        return left

    def negated():
        if ahead("NOT"):
            take()
            return ("not", negated())
        token = take()
        if token == "(":
            inner = either()
            if not ahead(")"):
                raise RuleError("missing closing parenthesis")
            take()
            return inner
        if token == ")" or token.upper() in ("AND", "OR"):
            raise RuleError(f"unexpected token: {token}")
        return ("phrase", token.strip('"') if token.startswith('"') else token)

    tree = either()
    if tokens:
        raise RuleError(f"unexpected token: {tokens[-1]}")
    return tree


def to_column(tree, text: Column) -> Column:
    kind, *rest = tree
    if kind == "phrase":
        return has_phrase(text, rest[0], blank=True)
    if kind == "not":
        return ~to_column(rest[0], text)
    left, right = (to_column(x, text) for x in rest)
    return left | right if kind == "or" else left & right


def compile_rule(expression: str, text: Column) -> Column:
    """The rule as a test of folded text."""
    return to_column(parse(expression), text)


def check_query(query: str | None) -> str | None:
    """The registry's laxer grammar: parentheses and operator places only. None, or what is wrong."""
    depth, open_ = 0, True
    words = (query or "").replace("(", " ( ").replace(")", " ) ").split()
    for word in words:
        if word == "(":
            depth, open_ = depth + 1, True
        elif word == ")":
            depth -= 1
            if depth < 0 or open_:
                return "invalid parentheses"
        elif word.upper() in ("AND", "OR"):
            if open_:
                return "operator without left operand"
            open_ = True
        else:
            open_ = word.upper() == "NOT"
    if depth:
        return "unbalanced parentheses"
    return "query cannot end with an operator" if words and open_ else None


def source_keywords(text: Column, terms: list[str], exclude: list[str] = (), mode: str = "any", query: str | None = None) -> Column:
    """A source's own keyword setting as a test of folded text; no terms let everything pass."""
    hits = [has_phrase(text, t) for t in terms]
    if mode == "boolean":
        if not query:
            raise RuleError("boolean mode needs a query")
        wanted = compile_rule(query, text)
    elif not hits:
        wanted = F.lit(True)
    else:
        wanted = hits[0]
        for h in hits[1:]:
            wanted = wanted & h if mode == "all" else wanted | h
    for e in exclude:
        wanted = wanted & ~has_phrase(text, e)
    return wanted
