"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into segments so few that of two fingerprints within `distance` bits one
segment differs by at most one bit (3 segments for 4 bits). Each fingerprint is filed under every
segment with every one of its bits left out; fingerprints that link meet in an equality partition and
are verified there by their full distance. Equal fingerprints are one class beforehand, so exact
copies cost one row. A bucket yields a spanning forest of its links, never all its pairs; a bucket
with over `bucket_rows` classes is filed again under variants of its other bits, until it is small,
which loses no link: fingerprints within `distance` overall are within it on the bits that remain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import partitions, slices, staged
from quern.llm.components import connected_components

FULL = (1 << 64) - 1


UNEVEN = re.compile(rb"[\t-\r ]{2,}|[\t-\r]")  # blanks other than one space


def shingle_hashes(texts: list[bytes], width: int, piece: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all texts' shingles in a row, and how many each text has. Texts are lower-cased; no
    object is made for a word, and only `piece` shingles are numbers of Python's at a time."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [np.zeros(0, "<u8")], []
    for text in texts:
        joined = UNEVEN.sub(b" ", text.lower()).strip(b" ")
        if not joined:
            counts.append(0)
            continue
        cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(joined)]))
        n = max(1, len(starts) - width + 1)
        counts.append(n)
        if n == 1:
            hashes.append(np.array([digest(joined, 42)], "<u8"))
        for i in range(0, n if n > 1 else 0, piece):
            to = min(n, i + piece)
            hashes.append(np.array([digest(joined[a:b], 42) for a, b in zip(starts[i:to].tolist(), ends[i + width - 1 : to + width - 1].tolist())], "<u8"))
    return np.concatenate(hashes), np.array(counts, np.int64)


def majority(hashes: np.ndarray, n: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """For each run of n hashes, the bits that are set in over half of it; bits are unpacked a piece at a time."""
    sums, owner = np.zeros((len(n), 64), np.int64), np.repeat(np.arange(len(n)), n)
    for i in range(0, len(hashes), piece):
        bits = np.unpackbits(hashes[i : i + piece].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i : i + piece]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sums[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            prints = majority(*shingle_hashes(texts, width)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(prints)], ["doc_id", "tag", "fp"])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tag, fp), tag being a hash of the text, by which rows with equal ids can be told apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, width=width), "doc_id long, tag long, fp long")


def variant_masks(used: int, distance: int) -> list[int]:
    """Masks that cut the bits outside `used` into segments and keep one segment without one of its bits."""
    rest = [i for i in range(64) if not used >> i & 1]
    pieces = distance // 2 + 1
    out = []
    for k in range(pieces):
        segment = rest[k * len(rest) // pieces : (k + 1) * len(rest) // pieces]
        whole = sum(1 << i for i in segment)
        out += [used | whole & ~(1 << i) for i in segment]
    return out


def _key(key: np.ndarray, mask: int, fps: np.ndarray) -> np.ndarray:
    """Mix into 64 bits; equal inputs meet, and others that meet are told apart by verification."""
    x = (fps & np.uint64(mask)) ^ np.uint64(mask * 0x9E3779B97F4A7C15 & FULL) ^ (key * np.uint64(0xD6E8FEB86659FD93))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _expand(fps: np.ndarray, keys: np.ndarray, used: int, distance: int) -> Iterator[pa.RecordBatch]:
    for mask in variant_masks(used, distance):
        yield _rows(_key(keys, mask, fps), np.full(len(fps), mask, np.uint64), fps)


def _rows(key: np.ndarray, mask: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, mask, fps)], ["key", "mask", "fp"])


def _first_variants(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        yield from _expand(fps, np.zeros(len(fps), np.uint64), 0, distance)


def _links_in(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among fps."""
    a, b = [], []
    left = fps.copy()
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                a += [int(x)] * len(found)
                b += found.tolist()
                queue += list(found)
    return a, b


def _buckets(batches: Iterator[pa.RecordBatch], distance: int, bucket_rows: int, wide: int = 16) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links (kind 0: key and fp are the ends) and, of oversize buckets, finer rows (kind 1)."""

    def links(a, b) -> pa.RecordBatch:
        a, b = (np.asarray(x, np.uint64) for x in (a, b))
        return with_kind(0, _rows(a, np.zeros(len(a), np.uint64), b))

    def with_kind(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, np.int32)), *rows.columns], ["kind", "key", "mask", "fp"])

    def closed(keys: np.ndarray, masks: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        lengths = np.diff(cuts)
        run = np.repeat(np.arange(len(lengths)), lengths)
        narrow = lengths[run] <= wide
        for shift in range(1, min(wide, int(lengths.max(initial=0)))):
            at = np.flatnonzero((run[shift:] == run[:-shift]) & narrow[shift:])
            at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance]
            if at.size:
                yield links(fps[at], fps[at + shift])
        for k in np.flatnonzero(lengths > wide):
            rows = slice(cuts[k], cuts[k + 1])
            used = int(masks[rows][0])
            if lengths[k] > bucket_rows and 64 - used.bit_count() > 12:
                for finer in _expand(fps[rows], keys[rows], used, distance):
                    yield with_kind(1, finer)
            else:
                yield links(*_links_in(fps[rows], distance))

    held: list[np.ndarray] = [np.zeros(0, np.uint64)] * 3
    refiled = None  # the key of an oversize bucket whose rows are filed again as they come
    for batch in batches:
        held = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64))) for i, h in enumerate(held)]
        while held[0].size:
            first = held[0][0]
            same = int(np.searchsorted(held[0].view(np.int64), first.view(np.int64), "right"))
            used = int(held[1][0])
            if refiled == first or same == held[0].size > bucket_rows and 64 - used.bit_count() > 12:
                refiled = first
                for finer in _expand(held[2][:same], held[0][:same], used, distance):
                    yield with_kind(1, finer)
                held = [h[same:] for h in held]
                continue
            if same == held[0].size:
                break
            last = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
            yield from closed(*(h[:last] for h in held))
            held = [h[last:] for h in held]
    if held[0].size:
        yield from closed(*held)


def link_edges(classes: DataFrame, distance: int, bucket_rows: int = 16384) -> DataFrame:
    """classes(fp), distinct -> links (a, b): a forest with the components of all links within `distance`."""
    n = partitions(classes.sparkSession)
    rows = classes.select("fp").mapInArrow(partial(_first_variants, distance=distance), "key long, mask long, fp long")
    edges = None
    while True:
        met = rows.repartition(n, "key").sortWithinPartitions("key")
        out = staged(met.mapInArrow(partial(_buckets, distance=distance, bucket_rows=bucket_rows), "kind int, key long, mask long, fp long"), "links")
        found = out.where("kind = 0").select(F.col("key").alias("a"), F.col("fp").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        rows = out.where("kind = 1").select("key", "mask", "fp")
        if rows.isEmpty():
            return edges


def _components(docs: DataFrame, width: int, distance: int, bucket_rows: int) -> DataFrame:
    """(doc_id, tag, fp, component_id)."""
    prints = staged(fingerprints(docs, width), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    parts = connected_components(link_edges(classes, distance, bucket_rows))
    known = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    known = staged(known, "parts")
    low = known.groupBy("part").agg(F.min("low").alias("component_id"))
    return prints.join(known.select("fp", "part").join(low, "part").select("fp", "component_id"), "fp")


def simhash_components(docs: DataFrame, *, width: int = 4, distance: int = 4, bucket_rows: int = 16384) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A null text is an empty one, whose fingerprint is zero; a null doc_id links like any other but never
    names a component unless all its ids are null (then null). Rows repeating an id are all returned.
    Columns other than doc_id and text are ignored. An empty table gives an empty result.
    """
    rows = _components(docs, width, distance, bucket_rows)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without(docs: DataFrame, gone: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs less the rows with the ids and texts in gone(doc_id, tag), with all their columns; texts are shuffled only
    where gone is too large to broadcast."""
    gone = staged(gone.select(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    tag = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (tag == gone["_gone_tag"]), "left_anti")


def keep_one(docs: DataFrame, *, width: int = 4, distance: int = 4, bucket_rows: int = 16384) -> DataFrame:
    """The documents that name their component, with all their columns. Of rows that repeat an id, those stay
    whose own text is in the component that the id names."""
    parts = _components(docs, width, distance, bucket_rows)
    return without(docs, parts.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "tag"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
