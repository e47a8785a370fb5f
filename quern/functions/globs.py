"""Shell globs: literals, ``?``, ``*``, classes with ranges, negation and escapes.

A pattern must match the whole text.  A bad pattern (an open or empty class, a
trailing backslash) matches nothing.  A negated class stands for the printable
ASCII characters that it doesn't list.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

PRINTABLE = [chr(c) for c in range(0x20, 0x7F)]
MOST_STRINGS = 200


class GlobError(ValueError):
    """One of: unterminated class, empty class, invalid escape, too many combinations, asterisk in enumeration."""


@lru_cache(maxsize=4096)
def parse(pattern: str) -> tuple[tuple[str, object], ...]:
    """Parts of a pattern: ("lit", char), ("any", None), ("many", None), ("class", sorted characters)."""
    out: list[tuple[str, object]] = []
    rest = iter(enumerate(pattern))
    for i, c in rest:
        if c == "\\":
            if i + 1 == len(pattern):
                raise GlobError("invalid escape")
            out.append(("lit", next(rest)[1]))
        elif c == "?":
            out.append(("any", None))
        elif c == "*":
            out.append(("many", None))
        elif c == "[":
            chars, end = _class(pattern, i + 1)
            out.append(("class", chars))
            while next(rest)[0] < end:
                pass
        else:
            out.append(("lit", c))
    return tuple(out)


def _class(pattern: str, at: int) -> tuple[tuple[str, ...], int]:
    negated = pattern[at : at + 1] in ("!", "^")
    at += negated
    members: list[str] = []
    first = True
    while at < len(pattern):
        c = pattern[at]
        if c == "]" and not first:
            if not members:
                raise GlobError("empty class")
            found = set(members)
            return tuple(sorted(set(PRINTABLE) - found if negated else found)), at
        if c == "\\":
            at += 1
            if at == len(pattern):
                raise GlobError("invalid escape")
            c = pattern[at]
        if pattern[at + 1 : at + 2] == "-" and pattern[at + 2 : at + 3] not in ("", "]"):
            members += [chr(x) for x in range(ord(c), ord(pattern[at + 2]) + 1)]
            at += 2
        else:
            members.append(c)
        at += 1
        first = False
    raise GlobError("unterminated class")


def to_regex(pattern: str) -> str | None:
    """An anchored regular expression of the same language, None for a bad pattern."""
    try:
        parts = parse(pattern)
    except GlobError:
        return None
    turn = {"any": lambda _: ".", "many": lambda _: ".*", "lit": re.escape, "class": lambda cs: "[" + "".join(re.escape(c) if c.isalnum() else "\\" + c for c in cs) + "]" if cs else "(?!)"}
    return "^(?s:" + "".join(turn[k](v) for k, v in parts) + ")$"


@lru_cache(maxsize=4096)
def _compiled(pattern: str):
    expression = to_regex(pattern)
    return expression and re.compile(expression[:-1] + r"\Z")


def matches(pattern: str, text: str) -> bool:
    found = _compiled(pattern)
    return bool(found and found.match(text))


def glob_match(text: Column, pattern: str) -> Column:
    """Whether a text matches one pattern, inside code generation."""
    expression = to_regex(pattern)
    return text.rlike(expression[:-1] + r"\z") if expression else F.lit(False)


@F.pandas_udf(BooleanType())
def glob_match_columns(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """The same for a pattern in each row; null if either is."""
    return pd.Series([None if t is None or p is None else matches(p, t) for t, p in zip(text, pattern, strict=True)])


def combinations_count(pattern: str) -> int:
    total = 1
    for kind, value in parse(pattern):
        if kind == "many":
            raise GlobError("asterisk in enumeration")
        total *= len(PRINTABLE) if kind == "any" else len(value) if kind == "class" else 1
    return total


def enumerate_strings(pattern: str) -> list[str]:
    """All strings of a pattern in code point order of its classes; none for one with ``*``, over 200 strings or a bad one."""
    try:
        if combinations_count(pattern) > MOST_STRINGS:
            return []
    except GlobError:
        return []
    choices = [PRINTABLE if k == "any" else v if k == "class" else (v,) for k, v in parse(pattern)]
    return ["".join(x) for x in itertools.product(*choices)]


@F.pandas_udf(ArrayType(StringType()))
def glob_enumerate(pattern: pd.Series) -> pd.Series:
    return pattern.map(lambda p: None if p is None else enumerate_strings(p))
