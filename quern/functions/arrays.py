"""Helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none() -> Column:
    return F.array().cast("array<string>")


def counted(terms: Column) -> Column:
    """array of (term, tf): the distinct terms in byte order, and how often each stands in the array. Null for an empty array."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1) != F.get(s, i)))
        return let(starts, lambda at: F.transform(at, lambda x, k: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - x).cast("long").alias("tf"))))

    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, of(s)))


def without_repeats(terms: Column) -> Column:
    """Drop each element equal to the one before it."""
    return let(terms, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x)))
