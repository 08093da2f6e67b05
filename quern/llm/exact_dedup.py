"""Exact dedup through an extendible-hash index in shared files. DataFrame operations only.

Texts are equal when they are identical after lower-casing A-Z (null counts as empty).

1. Keys. Every text's 64-bit key goes to the file `keys`; copies are counted by key.
2. Directory. Buckets are ranges of the key's leading bits. Starting from one bucket, every bucket with more
   than `capacity` rows is split in two, and the directory doubles where a bucket has used up its bits. Each
   bucket belongs to one owner task; owners have neighbouring buckets with about equally many rows.
3. Buckets. Texts go to their owner, which sorts them by key and bytes: equal keys form a chain, whose links
   are told apart by comparing bytes, so a collision never merges two texts. The smallest and largest of what
   a link holds give keep_id and group_size. The file `buckets` is what the owners return.
4. A key with very many copies (or bytes) is hot. Copies of a hot key are combined in the map tasks by their
   bytes and reach the owner as one row for each text. Their documents look their link up afterwards.

Hot keys are at most `HOT_KEYS` by count and as many by bytes, so they are broadcast; the directory has at most
2^MAX_DEPTH cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quern.llm._common import ascii_lower, partitions, scratch

HOT_KEYS = 1_000_000
MAX_DEPTH = 18
LINK = ["owner", "bucket", "key", "link"]


@dataclass(frozen=True)
class Directory:
    """buckets[i] = (prefix, depth, rows): keys whose top `depth` bits equal `prefix` share bucket i; in key order."""

    depth: int
    buckets: tuple[tuple[int, int, int], ...]

    def owners(self, tasks: int) -> list[int]:
        """The owner of each bucket: neighbours, with about total / tasks rows for each owner."""
        before = [0, *accumulate(rows for _, _, rows in self.buckets)]
        total = max(1, before[-1])
        return [min(tasks - 1, b * tasks // total) for b in before[:-1]]

    def cells(self, spark: SparkSession, tasks: int) -> DataFrame:
        """(cell, bucket, owner) for each of the 2^depth cells."""
        parts = [f"[{p << (self.depth - d)},{1 << (self.depth - d)},{o}]" for (p, d, _), o in zip(self.buckets, self.owners(tasks))]
        runs = F.posexplode(F.from_json(F.lit(f"[{','.join(parts)}]"), "array<array<int>>")).alias("bucket", "run")
        table = spark.range(1).select(runs)
        cell = F.explode(F.sequence(F.col("run")[0], F.col("run")[0] + F.col("run")[1] - 1)).alias("cell")
        return table.select(cell, "bucket", F.col("run")[2].alias("owner"))


def cell_of(key: Column, depth: int) -> Column:
    """The leading bits of the mixed key, so that weak keys spread as well."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - depth).cast("int") if depth else F.lit(0)


def grow_directory(keys: DataFrame, capacity: int | None = None, max_depth: int = MAX_DEPTH) -> Directory:
    """keys(key, and rows if they are not one each) -> the directory after splitting every overfull bucket.

    Without a capacity a bucket holds 256 rows, or as many more as keep the buckets below some 2^16.
    The driver gets at most 2^max_depth counts. Only keys that agree in all these bits of their mixed hash,
    so in practice copies of one key, can leave a bucket overfull.
    """
    rows = F.col("rows") if "rows" in keys.columns else F.lit(1)
    found = keys.groupBy(cell_of(F.col("key"), max_depth).alias("cell")).agg(F.sum(rows).alias("rows")).collect()
    counts = [0] * (1 << max_depth)
    for r in found:
        counts[r["cell"]] = r["rows"]
    before = [0, *accumulate(counts)]
    capacity = capacity or max(256, -(-before[-1] // (1 << 16)))
    depth, todo, done = 0, [(0, 0)], []
    while todo:
        prefix, d = todo.pop()
        width = 1 << (max_depth - d)
        held = before[(prefix + 1) * width] - before[prefix * width]
        if held <= capacity or d == max_depth:
            done.append((prefix, d, held))
            continue
        depth = max(depth, d + 1)  # a bucket that has used all bits of the directory doubles it
        todo += [(2 * prefix + 1, d + 1), (2 * prefix, d + 1)]
    return Directory(depth, tuple(done))


def _body(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


class ExactIndex:
    """The keys, the directory and, once chained, the buckets of a table of documents, in a folder that all tasks share.

    `key` may be any hash of the text to a long: weak ones only lengthen the chains.
    """

    def __init__(self, docs: DataFrame, *, capacity: int | None = None, key=F.xxhash64, path: str | None = None):
        self.spark, self.docs, self.key = docs.sparkSession, docs, key
        self.path, self.tasks = path or scratch(docs.sparkSession, "exact-dedup"), partitions(docs.sparkSession)
        texts = self._texts()
        self.keys = self._written(texts.select("doc_id", "key", F.octet_length("body").cast("long").alias("bytes")), "keys")
        counts = self.keys.groupBy("key").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
        counts = self._written(counts, "counts")
        rows, size, most, widest = counts.agg(F.sum("rows"), F.sum("bytes"), F.max("rows"), F.max(F.when(F.col("rows") > 1, F.col("bytes")))).first()
        many, wide = max(32, (rows or 0) // HOT_KEYS), max(8 << 20, (size or 0) // HOT_KEYS)
        hot = (F.col("rows") > 1) & ((F.col("rows") > many) | (F.col("bytes") > wide))
        self.hot = counts.where(hot).select("key") if (most or 0) > many or (widest or 0) > wide else None
        self.directory = grow_directory(counts.select("key", F.when(hot, F.lit(1)).otherwise(F.col("rows")).alias("rows")), capacity)
        self.cells = self._written(self.directory.cells(self.spark, self.tasks).coalesce(1), "directory")

    def _written(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _texts(self) -> DataFrame:
        body = self.docs.select(F.col("doc_id").cast(T.LongType()).alias("doc_id"), _body(F.col("text")).alias("body"), F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("row"))
        return body.withColumn("key", self.key(F.col("body")).cast("long"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Each row to the task that owns its bucket."""
        at = rows.withColumn("cell", cell_of(F.col("key"), self.directory.depth))
        return at.join(F.broadcast(self.cells), "cell").drop("cell").repartitionById(self.tasks, F.col("owner"))

    def _rows(self, carry: bool) -> DataFrame:
        """What goes to the owners: documents, and one row for each text of a hot key (`hot`), combined in the map tasks."""
        texts = self._texts()
        more = ["row"] if carry else []
        cold = texts if self.hot is None else texts.join(F.broadcast(self.hot), "key", "left_anti")
        cold = cold.select("key", "body", "doc_id", F.lit(1).cast("long").alias("rows"), F.lit(False).alias("hot"), *more)
        if self.hot is None:
            return cold
        best = [F.max_by("row", F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("row")] if carry else []
        warm = texts.join(F.broadcast(self.hot), "key", "left_semi").groupBy("key", "body").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.lit(True).alias("hot"), *best)
        return cold.unionByName(warm.select(*cold.columns))

    def chained(self) -> DataFrame:
        """The buckets: (owner, bucket, key, link, links, digest, doc_id, rows, hot, keep_id, group_size)."""
        linked = self._dealt(self._rows(False)).withColumn("link", F.dense_rank().over(W.partitionBy("owner", "bucket", "key").orderBy("body")))
        linked = linked.select(*LINK, F.sha2("body", 256).alias("digest"), "doc_id", "rows", "hot")
        link, chain = W.partitionBy(*LINK), W.partitionBy("owner", "bucket", "key")
        done = linked.withColumns({"keep_id": F.max("doc_id").over(link), "group_size": F.sum("rows").over(link), "links": F.max("link").over(chain)})
        return self._written(done, "buckets")

    def lookup(self) -> DataFrame:
        """(doc_id, digest, keep_id, group_size) for every document. Those of hot keys look up their link: by key
        where its chain has one link, by key and digest where it has several."""
        buckets = self.chained()
        out = ["doc_id", "digest", "keep_id", "group_size"]
        found = buckets.where(~F.col("hot")).select(*out)
        if self.hot is None:
            return found
        entries = buckets.where("hot").select("key", "links", "digest", "keep_id", "group_size")
        count, links = entries.agg(F.count("*"), F.max("links")).first()
        small = F.broadcast if count <= 2 * HOT_KEYS else lambda df: df
        if links == 1:
            return found.unionByName(self.keys.join(small(entries), "key").select(*out))
        warm = self._texts().join(F.broadcast(self.hot), "key", "left_semi").select("doc_id", "key", F.sha2("body", 256).alias("digest"))
        return found.unionByName(warm.join(small(entries), ["key", "digest"]).select(*out))

    def kept(self) -> DataFrame:
        """The document that stays of each link, with all its columns."""
        body = F.coalesce(F.col("body"), F.lit(""))
        order = W.partitionBy("owner", "bucket", "key").orderBy(body, F.col("doc_id").desc_nulls_last())
        # the text is in the row already, so the owner lower-cases it again rather than get it twice
        dealt = self._dealt(self._rows(True).drop("body")).withColumn("body", _body(F.col("row.text")))
        first = dealt.withColumn("before", F.lag("body").over(order)).where(~F.col("before").eqNullSafe(F.col("body")))
        return first.select(*[F.col("row").getField(c).alias(c) for c in self.docs.columns])


def exact_dedup(docs: DataFrame, *, capacity: int | None = None, key=F.xxhash64, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of each group of equal texts stays; rows repeating that very id
    are all marked kept. A null text is an empty one, a null doc_id counts as smaller than any other,
    other columns are ignored, and an empty table gives an empty result.
    """
    found = ExactIndex(docs.select("doc_id", "text"), capacity=capacity, key=key, path=path).lookup()
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; of rows repeating an id with equal text, one."""
    return ExactIndex(docs, **options).kept()


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
with d as (
  select cast(doc_id as bigint) as doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
  from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from d group by body)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.body) as text_sha256
from d join g on d.body = g.body
"""
