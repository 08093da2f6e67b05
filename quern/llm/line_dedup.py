"""Line dedup by pairwise alignment.

Documents that share lines are found through the lines' hashes, aligned in pairs with patience diff, and
the aligned lines are deleted from the later document. Which pairs are aligned:

1. Holders of a rare line (one that `rare_df` documents have at most) meet each other, all pairs.
2. Of a frequent line, every holder meets the earliest one. Nearly always the line is aligned there and
   goes; where it stays (the documents have their lines in another order, or it comes more often), the
   earliest document that still has it is the next one that all others which still have it meet; and so
   on, until no line is left that two such documents have. So no holder is left out, and a line that very
   many documents share costs as many pairs as it has holders, not their square.

Documents with the very same lines are one document beforehand, represented by the earliest. Pairs go to
blocks of at most `block` later documents, which get the earlier document's lines once. Lines are compared
by 128 bits: by a 64-bit hash, which is checked against a second one over all lines of the corpus and
replaced for lines that collide.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import partitions, slices, staged

LAST = (1 << 63) - 1  # stands for a null id: after all others
NODE = "struct<doc:bigint,tag:bigint>"


def patience(a: list[int | None], b: list[int | None]) -> list[tuple[int, int]]:
    """Aligned places of a and b. Lines that both sides of a stretch have once, in their longest common order, anchor it;
    equal lines next to the ends of a stretch extend it; what is left between anchors is treated alike. A stretch without
    such lines is anchored by its repeated ones: the first to the first, the second to the second. None never aligns."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            if a[i] is not None:
                out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            if a[m] is not None:
                out.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if x is not None and in_b[x] == 1}
        common = [(k, place[x]) for k, x in enumerate(a[i:m], i) if x in place and in_a[x] == 1]
        if not common:
            seen_b, seen_a = Counter(), Counter()
            nth = {}
            for k, x in enumerate(b[j:n], j):
                nth[x, seen_b[x]] = k
                seen_b[x] += 1
            for k, x in enumerate(a[i:m], i):
                if x is not None and (x, seen_a[x]) in nth:
                    common.append((k, nth[x, seen_a[x]]))
                seen_a[x] += 1
        tails: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for k, (_, y) in enumerate(common):
            at = bisect_left(tails, y)
            back.append(last[at - 1] if at else -1)
            tails[at : at + 1] = [y]
            last[at : at + 1] = [k]
        k = last[-1] if last else -1
        chain = []
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        if not chain:
            continue
        out += chain
        edges = [(i - 1, j - 1), *chain[::-1], (m, n)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, late, node, seq) sorted so that a block's earlier document (late 0) stands before its later ones -> what goes
    from each of these. Only the earlier document and one later one are lists at a time."""
    early: list[int | None] = []
    for batch in batches:
        nodes, gone = [], []
        for late, node, seq in zip(*(batch.column(c) for c in ("late", "node", "seq"))):
            if not late.as_py():
                early = seq.as_py()
                continue
            places = [y for _, y in patience(early, seq.as_py())]
            if places:
                nodes.append(node.as_py())
                gone.append(places)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.column("node").type), pa.array(gone, pa.list_(pa.int32()))], ["node", "gone"])


def _kept_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, seq, gone) -> (node, kept): the distinct lines that a document still has."""
    for batch in batches:
        kept = []
        for seq, gone in zip(batch.column("seq"), batch.column("gone")):
            lines = np.array([x for x in seq.as_py()], object)
            if gone.is_valid:
                lines = np.delete(lines, gone.values.to_numpy(zero_copy_only=False))
            kept.append(sorted({x for x in lines.tolist() if x is not None}))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(kept, pa.list_(pa.int64()))], ["node", "kept"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n, removed, kept = [], [], []
            for text, copy, gone in zip(*(part.column(c).to_pylist() for c in ("text", "copy", "gone"))):
                lines = text.split("\n")
                drop = {k for k, x in enumerate(lines) if x.strip()} if copy else set(gone or ())
                n.append(len(lines))
                removed.append(len(drop))
                kept.append("\n".join([x for k, x in enumerate(lines) if k not in drop]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)], ["doc_id", "n_lines", "n_removed", "kept_text"])


def _trimmed(line: Column) -> Column:
    return F.rtrim(line, F.lit(" \t\r\x0b\x0c"))


def _hash(line: Column, salt: str | None = None) -> Column:
    return F.xxhash64(line) if salt is None else F.xxhash64(F.lit(salt), line)


def line_hashes(lines: DataFrame) -> Column:
    """lines(line), all lines of the corpus -> a function of the column `lines` that gives their hashes, null for blank
    ones. Hashes that two different lines have (told by a second hash) are replaced by both hashes' hash."""
    seen = lines.groupBy(_hash(F.col("line")).alias("h")).agg(F.min(_hash(F.col("line"), "2")).alias("lo"), F.max(_hash(F.col("line"), "2")).alias("hi"))
    collided = [r["h"] for r in seen.where("lo <> hi").select("h").collect()]  # about n^2 / 2^65 of n lines

    def of(line: Column) -> Column:
        h = _hash(line)
        h = F.when(h.isin(*collided), F.xxhash64(h, _hash(line, "2"))).otherwise(h) if collided else h
        return F.when(line != "", h)

    return F.transform("lines", of)


def _aligned(pairs: DataFrame, seqs: DataFrame, block: int) -> DataFrame:
    """pairs(a, b), seqs(node, seq) -> (node, gone): the places of each b that its alignments with all its a take away."""
    n = partitions(pairs.sparkSession)
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("blk"), "b")
    late = dealt.join(seqs.withColumnRenamed("node", "b"), "b").select("a", "blk", F.lit(1).alias("late"), F.col("b").alias("node"), "seq")
    early = dealt.select("a", "blk").distinct().join(seqs.withColumnRenamed("node", "a"), "a").select("a", "blk", F.lit(0).alias("late"), F.col("a").alias("node"), "seq")
    rows = late.unionByName(early).repartition(n, "a", "blk").sortWithinPartitions("a", "blk", "late")
    gone = rows.select("late", "node", "seq").mapInArrow(_align, f"node {NODE}, gone array<int>")
    return gone.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def line_dedup(docs: DataFrame, *, rare_df: int = 4, block: int = 512) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text (kept lines joined by newlines) for every row.

    Lines are split at newlines and compared without trailing ASCII blanks; blank lines are always kept. A null
    text is an empty one, which is one blank line. Of rows with equal ids, one with other text is another
    document, ordered by a hash of its text; one with the same text repeats the result. A null id comes
    after all others. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    node = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tag")).alias("node")
    split = base.select(node, F.transform(F.split("text", "\n", -1), _trimmed).alias("lines"))
    seqs = split.select("node", line_hashes(split.select(F.explode("lines").alias("line"))).alias("seq"))
    seqs = staged(seqs.select("node", "seq", F.xxhash64("seq").alias("same"), F.xxhash64(F.lit("2"), "seq").alias("also")), "line-hashes")
    groups = seqs.groupBy("same", "also").agg(F.min("node").alias("rep"))
    marked = staged(seqs.join(groups, ["same", "also"]).select("node", "seq", (F.col("node") != F.col("rep")).alias("copy")), "line-copies")
    reps = marked.where("not copy").select("node", "seq").dropDuplicates(["node"])

    held = reps.select("node", F.explode(F.array_distinct("seq")).alias("line")).where("line is not null")
    stats = staged(held.groupBy("line").agg(F.min("node").alias("first"), F.count("*").alias("df")).where("df > 1"), "line-stats")
    frequent = stats.where(F.col("df") > rare_df).select("line", "first")
    star = held.join(frequent, "line").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    rare = held.join(stats.where(F.col("df") <= rare_df).select("line"), "line").groupBy("line").agg(F.array_sort(F.collect_list("node")).alias("all"))
    rare = rare.select(F.explode("all").alias("b"), "all").select("b", F.explode(F.filter("all", lambda x: x < F.col("b"))).alias("a")).select("a", "b")
    gone = staged(_aligned(star.unionByName(rare).distinct(), reps, block), "line-gone")

    used = frequent  # a line's documents that the others have met
    open_ = staged(star.select(F.col("b").alias("node")).distinct(), "line-open")
    while True:
        now = reps.join(open_, "node", "left_semi").join(gone, "node", "left").select("node", "seq", "gone").mapInArrow(_kept_lines, f"node {NODE}, kept array<bigint>")
        left = now.select("node", F.explode("kept").alias("line")).join(frequent.select("line"), "line", "left_semi")
        left = left.join(used.select("line", F.col("first").alias("node")), ["line", "node"], "left_anti")
        left = staged(left, "line-left")
        next_ = staged(left.groupBy("line").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("line", "first"), "line-next")
        if next_.isEmpty():
            break
        pairs = left.join(next_, "line").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        pairs = staged(pairs, "line-pairs")
        more = gone.unionByName(_aligned(pairs, reps, block)).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
        gone, used = staged(more, "line-gone"), used.unionByName(next_)
        open_ = staged(pairs.select(F.col("b").alias("node")).unionByName(pairs.select(F.col("a").alias("node"))).distinct(), "line-open")
    decided = marked.select("node", "copy").distinct().join(gone, "node", "left").where("copy or gone is not null")
    decided = staged(decided, "line-decisions")
    return base.withColumn("node", node).join(decided, "node", "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "gone").mapInArrow(_finish, "doc_id long, n_lines long, n_removed long, kept_text string")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
