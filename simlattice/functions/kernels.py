"""Kernels without a relational form: common subsequences, similarity ratios, and source stripping."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS, _TEXTS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())


def lcs(a: list[int], b: list[int]) -> list[int]:
    """A longest common subsequence; of several, the one that going back from the ends finds by leaving out the last of ``a`` first."""
    x, y = np.asarray(a), np.asarray(b)
    n, m = len(x), len(y)
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        # a row at once: the best of 'above' and 'diagonal + 1', then the running maximum for 'left'
        best = np.where(y == x[i - 1], table[i - 1, :-1] + 1, table[i - 1, 1:])
        table[i, 1:] = np.maximum.accumulate(np.maximum(best, table[i - 1, 1:]))
    i, j, out = n, m, []
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(int(x[i - 1]))
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def fold_lcs(sequences: list[list[int]]) -> list[int]:
    """The common subsequence of all, folded from the first; stops when nothing is left."""
    common = list(sequences[0]) if sequences else []
    for s in sequences[1:]:
        if not common:
            break
        common = lcs(common, s)
    return common


@F.pandas_udf(_INTS)
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(_INTS)
def fold_lcs_udf(sequences: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in sequences:
        yield pd.Series([fold_lcs([list(s) for s in group]) for group in batch])


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two texts or lists are, by matching blocks; 1 if both are empty, null if one is null."""

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = (x, y) if isinstance(x, str) else (list(x), list(y))
        return SequenceMatcher(a=x, b=y).ratio() if len(x) or len(y) else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


_PARTS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|`[^`]*(?:`|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)", re.S)
_NOT_END = re.compile(r"[^\n]")


def _blanked(m: re.Match) -> str:
    part = m[0]
    if part[0] == "/":
        return _NOT_END.sub(" ", part)
    inner = part[1:-1] if len(part) > 1 and part[-1] == part[0] else part[1:]
    return part[0] + _NOT_END.sub(" ", inner) + part[1 + len(inner) :]


def strip_source(source: str) -> str:
    """The source with comments and the insides of literals turned to blanks; every character keeps its place."""
    return _PARTS.sub(_blanked, source)


_LANDMARK = re.compile(r"^func\b|\{|\}", re.M)
_HEAD = re.compile(r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(")


def functions_in(stripped: str) -> Iterator[tuple[str, int, int]]:
    """(name, begin, end) of the functions in a stripped source, in one pass: from the head to where its first block closes."""
    open_heads: list[tuple[str, int]] = []
    depth = 0
    for mark in _LANDMARK.finditer(stripped):
        if mark[0] == "func":
            head = _HEAD.match(stripped, mark.start())
            open_heads, depth = ([(head[1], mark.start())] if head else []), 0
        elif open_heads:
            depth += 1 if mark[0] == "{" else -1
            if depth == 0:
                name, begin = open_heads.pop()
                yield name, begin, mark.end()


def find_function(source: str, name: str) -> tuple[str, str] | None:
    """The function's text, as it is and stripped; None if it isn't there or never ends."""
    stripped = strip_source(source)
    return next(((source[a:b], stripped[a:b]) for n, a, b in functions_in(stripped) if n == name), None)


def normal_form(body: str) -> str:
    return " ".join(strip_source(body).split())


_COARSE = re.compile(r"\b(break|case|continue|defer|for|go|goto|if|range|return|select|switch)\b|:=|(?<![-=!<>:+*/%&|^])=(?!=)|\w+(?:\.\w+)*\s*\(")


def coarse_tokens(stripped: str) -> list[str]:
    """Keywords, assignments and calls of a stripped body, in order."""
    out = []
    for m in _COARSE.finditer(stripped):
        t = m[0]
        out.append(("CALL_Q" if "." in t else "CALL") if t[-1] == "(" else "ASSIGN" if t[-1] == "=" else t.upper())
    return out


@F.pandas_udf(T.StringType())
def normal_form_udf(body: pd.Series) -> pd.Series:
    return body.map(lambda x: None if x is None else normal_form(x))


@F.pandas_udf(_TEXTS)
def coarse_tokens_udf(body: pd.Series) -> pd.Series:
    return body.map(lambda x: None if x is None else coarse_tokens(strip_source(x)))


@F.pandas_udf(T.StringType())
def find_function_udf(source: pd.Series, name: pd.Series) -> pd.Series:
    """The text of the named function in the source; null if it isn't there."""

    def one(s, n):
        hit = find_function(s, n) if s is not None and n is not None else None
        return hit[0] if hit else None

    return pd.Series([one(s, n) for s, n in zip(source, name, strict=True)], dtype=object)
