"""Approximate nearest neighbours by a forest of random-projection trees.

Equal vectors are one point, which carries the smallest ids of its copies (one more than asked for,
as a query leaves itself out); so copies, however many, cost one point and lose nothing. Trees are
fitted on a bounded sample: each split projects on the difference of two sampled points and cuts at a
sample median. Every point is indexed, in one leaf of each tree.

A query walks all trees with one priority queue of open branches, nearest first by the largest margin
crossed so far, and takes leaves until they hold `search_share` of all points, copies of a point in
several trees counted (`search_points` at least). Points without clusters in many dimensions, as in the
test tables, need that share for a recall of 0.9; clustered ones do with far less. Leaf sizes are known by then:
at most trees * 2^depth counts. Queries and points meet by leaf, points streaming past the queries in
batches; each task keeps its best points for each query by exact distance in double precision, and a
window picks the nearest of all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm._common import partitions, staged


@dataclass
class Tree:
    """Complete binary tree: node i splits by normals[i] . x > cuts[i] into 2i+1 and 2i+2; leaves are numbered from 0."""

    normals: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", x, self.normals[node]) > self.cuts[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    dim = sample.shape[1]
    normals, cuts = np.zeros((2**depth - 1, dim)), np.zeros(2**depth - 1)
    members = {0: np.arange(len(sample))}
    for i in range(2**depth - 1):
        rows = members.pop(i)
        pair = sample[rng.choice(rows, 2)] if len(rows) > 1 else rng.normal(size=(2, dim))
        normal = pair[0] - pair[1]
        norm = np.sqrt(normal @ normal)
        normal = normal / norm if norm > 0 else rng.normal(size=dim) / np.sqrt(dim)
        side = sample[rows] @ normal
        normals[i], cuts[i] = normal, np.median(side) if len(rows) else 0.0
        members[2 * i + 1], members[2 * i + 2] = rows[side <= cuts[i]], rows[side > cuts[i]]
    return Tree(normals, cuts, depth)


def chosen_leaves(x: np.ndarray, forest: list[Tree], sizes: np.ndarray, search_points: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order one priority queue over all trees opens them, until they hold search_points points."""
    queue: list[tuple[float, int, int]] = [(0.0, t, 0) for t in range(len(forest))]
    out, held = [], 0
    while queue and held < search_points:
        crossed, t, node = heapq.heappop(queue)
        tree = forest[t]
        inner = 2**tree.depth - 1
        while node < inner:
            margin = float(tree.normals[node] @ x) - tree.cuts[node]
            near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(crossed, abs(margin)), t, far))
            node = near
        if n := int(sizes[t, node - inner]):
            out.append((t, node - inner))
            held += n
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _binary(x: np.ndarray) -> pa.Array:
    """A row's bytes each."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


class Best:
    """The `keep` nearest points of each query among those seen, each once, ties to the smaller first id."""

    def __init__(self, keep: int):
        self.keep, self.of = keep, {}

    def add(self, query: int, d: np.ndarray, first: np.ndarray, ids: list) -> None:
        held = self.of.setdefault(query, {})
        for x, f, all_ids in zip(d.tolist(), first.tolist(), ids):
            held[f] = (x, all_ids)
        if len(held) > self.keep:
            nearest_ = sorted((x, f) for f, (x, _) in held.items())[: self.keep]
            self.of[query] = {f: held[f] for _, f in nearest_}

    def limit(self, query: int) -> float:
        held = self.of.get(query)
        return max(x for x, _ in held.values()) if held and len(held) >= self.keep else np.inf

    def rows(self) -> pa.RecordBatch:
        out = [(q, x, ids) for q, held in self.of.items() for x, ids in held.values()]
        self.of = {}
        q, x, ids = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.float64()), pa.array(ids, pa.list_(pa.int64()))], ["query_id", "score", "ids"])


def _rerank(batches: Iterator[pa.RecordBatch], dim: int, kind: str, keep: int, max_queries: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows (tree, leaf, role, ids, v) sorted so that a leaf's queries (role 0) stand before its points -> (query_id, score, ids)."""
    best, now, asked, vectors, norms = Best(keep), None, [], None, None
    for batch in batches:
        leaf = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "leaf", "role")], 1)
        x = np.frombuffer(b"".join(batch.column("v").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
        cuts = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]).any(1), [True])))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at, role = tuple(leaf[lo, :2].tolist()), leaf[lo, 2]
            if at != now:
                if len(best.of) > max_queries:
                    yield best.rows()
                now, asked, vectors = at, [], np.zeros((0, dim))
            if role == 0:
                asked += [i[0] for i in batch.column("ids").slice(lo, hi - lo).to_pylist()]
                vectors = np.concatenate((vectors, x[lo:hi]))
                norms = (vectors**2).sum(1)
            elif asked:
                own = x[lo:hi]
                size = (own**2).sum(1)
                ids = batch.column("ids").slice(lo, hi - lo)
                first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
                for i, q in enumerate(asked):
                    # products are near enough to tell who may be among the nearest; distances are exact
                    near = size + norms[i] - 2 * (own @ vectors[i])
                    slack = 1e-9 * (norms[i] + size)
                    bound = best.limit(q) ** 2
                    if len(near) > keep:
                        k = np.argpartition(near, keep - 1)[:keep]
                        bound = min(bound, float((near[k] + slack[k]).max()))
                    may = np.flatnonzero(near - slack <= bound)
                    d = np.sqrt(((own[may] - vectors[i]) ** 2).sum(1))
                    best.add(q, d, first[may], ids.take(pa.array(may)).to_pylist())
    yield best.rows()


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, trees: int = 24, leaf_points: int | None = None, search_share: float = 0.6, search_points: int = 8000, sample_points: int = 20_000, seed: int = 0) -> DataFrame:
    """vectors(vec_id, embedding), queries(vec_id, embedding) -> query_id, rank, vec_id, score.

    The k nearest found by Euclidean distance, ties to the smaller id, without the query's own id.
    Vectors that are null, zero or hold null or non-finite components, rows with a null id, and vectors
    of another length than the most frequent one take no part. Rows that repeat an id with the same
    vector are one row; with different vectors, each is a candidate. Other columns are ignored.
    """
    spark = vectors.sparkSession
    n_parts = partitions(spark)
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    held_as = "array<float>" if kind == "<f4" else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(held_as).alias("v"))
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))

    rows = clean(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    rows = rows.where(F.size("v") == dim).distinct()
    few = rows.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    points = staged(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "v"), "points")
    n = points.count()
    leaf_points = leaf_points or int(np.clip(n / 256, 64, 4096))
    search_points = max(search_points, int(search_share * n))
    sample = points.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(sample_points).select("v").toArrow().column("v").combine_chunks()
    sample = _matrix(sample, dim).astype(np.float64)
    depth = int(max(0, np.ceil(np.log2(max(1, min(n / leaf_points, len(sample) / 4))))))
    rng = np.random.default_rng(seed)
    forest = [grow(sample, depth, rng) for _ in range(trees)]
    held = spark.sparkContext.broadcast(forest)
    rows_of = "tree int, leaf long, role int, ids array<long>, v binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("v"), dim)
            x, v = own.astype(np.float64), _binary(own)
            for t, tree in enumerate(held.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(tree.leaves(x)), pa.array(np.ones(len(x), np.int32)), batch.column("ids"), v], ["tree", "leaf", "role", "ids", "v"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees, 2**depth), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), dim).astype(np.float64)
            for t, tree in enumerate(held.value):
                sums[t] += np.bincount(tree.leaves(x), minlength=2**depth)
        t, leaf = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int64)), pa.array(sums[t, leaf])], ["tree", "leaf", "n"])

    counts = np.zeros((trees, 2**depth), np.int64)
    for r in points.select("v").mapInArrow(count, "tree int, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["tree"], r["leaf"]] = r["n"]
    sizes = spark.sparkContext.broadcast(counts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("v"), dim)
            picked = [chosen_leaves(x, held.value, sizes.value, search_points) for x in own.astype(np.float64)]
            at = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
            flat = np.array([x for p in picked for x in p], np.int64).reshape(-1, 2)
            columns = [pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1]), pa.array(np.zeros(len(at), np.int32)), batch.column("ids").take(pa.array(at)), _binary(own[at])]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "role", "ids", "v"])

    asked = clean(queries).where(F.size("v") == dim).distinct().select(F.array("vec_id").alias("ids"), "v")
    routed = asked.repartition(n_parts).mapInArrow(route, rows_of)
    met = points.mapInArrow(place, rows_of).unionByName(routed).repartition(n_parts, "tree", "leaf").sortWithinPartitions("tree", "leaf", "role")
    near = met.mapInArrow(partial(_rerank, dim=dim, kind=kind, keep=k + 1), "query_id long, score double, ids array<long>")
    best = near.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
