"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import staged


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by stars of the batch's own components: fewer rows, same components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        links = [(x, root(x)) for x in list(parent)]
        links = [(x, r) for x, r in links if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], ["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node points to one root, and no root points anywhere."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    per_node = ends.groupBy("x").agg(F.sum("out").alias("outs"), F.min("out").alias("least"))
    return per_node.where("outs > 1 or (outs = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> (node, component) for every node on an edge; component is its smallest node.

    Rounds end when the edges are stars, after about the logarithm of the number of nodes. Every round
    is written to the shared folder. Minima combine on the map side, and the joins that hand them back
    leave a node with very many neighbours to AQE's splitting of skewed partitions.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = staged(edges.mapInArrow(_forest, "a long, b long").distinct().mapInArrow(_forest, "a long, b long").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large["a"] == low["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = staged(small.select("e.*").where("a <> b").distinct(), "small")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
