"""Posting lists as sorted arrays of ids, and their encodings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import let


class CorruptPosting(ValueError):
    """An encoded posting list that ends inside a number."""


def new(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def add(a: Column, ids: Column) -> Column:
    return F.array_sort(F.array_union(a, ids))


append_sorted = union = add


def remove(a: Column, doc_id: Column) -> Column:
    return F.array_remove(a, doc_id)


def removed(a: Column, doc_id: Column) -> Column:
    """Whether `remove` takes something away."""
    return F.array_contains(a, doc_id)


def lowest(a: Column) -> Column:
    """The first id; null for an empty list."""
    return F.get(a, F.lit(0))


def highest(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


remove_set = difference


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def contains(a: Column, doc_id) -> Column:
    return F.array_contains(a, doc_id)


def within(a: Column, lo: int, hi: int) -> Column:
    """The ids from lo to hi, both included."""
    return F.filter(a, lambda x: x.between(lo, hi))


def keep(a: Column, test) -> Column:
    return F.filter(a, test)


def seek(a: Column, doc_id: int) -> Column:
    """The first id not below doc_id, or null."""
    return F.get(F.filter(a, lambda x: x >= doc_id), F.lit(0))


def remaining(a: Column, doc_id: int) -> Column:
    return F.size(F.filter(a, lambda x: x >= doc_id))


def intersect_many(first: Column, *rest: Column) -> Column:
    for x in rest:
        first = intersect(first, x)
    return first


def union_many(first: Column, *rest: Column) -> Column:
    for x in rest:
        first = union(first, x)
    return new(first)


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def deltas(a: Column) -> Column:
    """The first id, then the gaps."""
    return F.transform(a, lambda x, i: x - F.coalesce(F.get(a, i - 1), F.lit(0)))


def from_deltas(d: Column) -> Column:
    """Running sums, by doubling: after the step for k every place holds the sum of up to 2k gaps."""

    def step(k: int):
        return lambda a: F.when(F.size(a) > k, F.transform(a, lambda x, i: x + F.when(i >= k, F.get(a, i - k)).otherwise(F.lit(0)))).otherwise(a)

    out = d
    for i in range(31):
        out = let(out, step(1 << i))
    return out


def encoded_size(a: Column) -> Column:
    """An upper estimate of the encoded bytes."""
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, 1).otherwise(8 + 3 * F.size(a))


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bytes that each number takes in base 128."""
    return 1 + sum((values >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10))


def encode_ids(ids) -> bytes:
    """Count, then gaps, as base-128 numbers, lowest part first."""
    ids = np.asarray(ids, np.int64).view(np.uint64)
    values = np.concatenate((np.array([len(ids)], np.uint64), np.diff(ids, prepend=np.uint64(0)))) if len(ids) else np.zeros(1, np.uint64)
    sizes = _sizes(values)
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    parts = np.repeat(values, sizes) >> (at * 7).astype(np.uint64) & np.uint64(127)
    last = np.zeros(ends[-1], bool)
    last[ends - 1] = True
    return np.where(last, parts, parts | np.uint64(128)).astype(np.uint8).tobytes()


def decode_ids(data: bytes) -> list[int]:
    """Inverse; nothing decodes to no ids, and what follows the last id is ignored."""
    if not data:
        return []
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    count, first = 0, ends[0] + 1 if len(ends) else 0
    for k in range(min(first, 10)):
        count |= int(b[k] & 127) << 7 * k
    if not len(ends) or first > 10 or len(ends) - 1 < count:
        raise CorruptPosting("posting list ends inside a number")
    if not count:
        return []
    ends = ends[: count + 1]
    sizes = np.diff(ends)
    if (sizes > 10).any():
        raise CorruptPosting("posting list holds a number of over 64 bits")
    starts = ends[:-1] + 1
    at = np.arange(first, ends[-1] + 1) - np.repeat(starts, sizes)
    parts = (b[first : ends[-1] + 1] & 127).astype(np.uint64) << (at * 7).astype(np.uint64)
    gaps = np.bitwise_or.reduceat(parts, starts - first)
    return np.cumsum(gaps).view(np.int64).tolist()


def _raw(ids) -> bytes:
    return np.asarray(ids, "<i8").tobytes()


def _from_raw(data: bytes) -> list[int]:
    return np.frombuffer(data, "<i8").tolist() if len(data) % 8 == 0 else []


def _column(f, returns: str, c: Column) -> Column:
    def over(values):
        return values.map(f, na_action="ignore")

    return F.pandas_udf(over, returns)(c)


def encode(ids: Column) -> Column:
    return _column(encode_ids, "binary", ids)


def decode(data: Column) -> Column:
    return _column(decode_ids, "array<bigint>", data)


def encode_raw(ids: Column) -> Column:
    """Eight bytes an id, lowest first."""
    return _column(_raw, "binary", ids)


def decode_raw(data: Column) -> Column:
    """Inverse; a length that eight does not divide gives no ids."""
    return _column(_from_raw, "array<bigint>", data)


class Cursor:
    """Walks the ids of a one-column DataFrame in order, a partition at a time."""

    def __init__(self, ids: DataFrame):
        self.ids = ids
        self.reset()

    def reset(self) -> None:
        self._rows: Iterator = self.ids.orderBy(self.ids.columns[0]).toLocalIterator()
        self._ahead: int | None = None
        self._done = False

    def peek(self) -> int | None:
        if self._ahead is None and not self._done:
            row = next(self._rows, None)
            self._done, self._ahead = row is None, None if row is None else row[0]
        return self._ahead

    def next(self) -> int | None:
        out, self._ahead = self.peek(), None
        return out

    def seek(self, doc_id: int) -> int | None:
        while (x := self.peek()) is not None and x < doc_id:
            self._ahead = None
        return x


def intersect_each(a: Cursor, b: Cursor, visit) -> None:
    """Call visit with each common id in order, until it returns something false. Whichever cursor is behind seeks the other."""
    while (x := a.peek()) is not None and (y := b.peek()) is not None:
        if x == y:
            if not visit(x):
                return
            a.next()
            b.next()
        elif x < y:
            a.seek(y)
        else:
            b.seek(x)
