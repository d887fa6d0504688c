"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the corpus tools understand it, for Java's regular expressions.
SPACE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(replace(text, f"[{SPACE}]+", " "))


def words(text: Column) -> Column:
    """The non-empty words between white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def round_half_up(x: Column) -> Column:
    """Rounds halves up, also below zero, as an integer."""
    return F.floor(x + F.lit(0.5)).cast("int")


def percent(part: Column, whole: Column) -> Column:
    return round_half_up(part.cast("double") / whole.cast("double") * F.lit(100.0))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, as arrays."""

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n))
        return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<array<string>>"))

    return bound(tokens, of)
