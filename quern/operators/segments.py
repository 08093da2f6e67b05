"""Segments as tables: live(segment_id, doc_id), postings(segment_id, doc_id, term, ...), tombstones(segment_id, doc_id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["segment_id", "doc_id"]


class SegmentError(ValueError):
    """A merge or a segment that breaks its invariants."""


@dataclass(frozen=True)
class Meta:
    id: int
    doc_count: int
    min_doc: int
    max_doc: int
    term_count: int
    created: int = 0


@dataclass(frozen=True)
class Policy:
    """When to merge. max_docs_per_segment is accepted and has no effect."""

    max_segments: int = 8
    max_docs_per_segment: int = 10_000
    min_merge: int = 2

    def should_merge(self, metas: list[Meta]) -> bool:
        return 0 < self.max_segments <= len(metas)

    def needs_compaction(self, metas: list[Meta]) -> bool:
        """Also when enough segments have under 32 documents."""
        tiny = sum(m.doc_count < 32 for m in metas)
        return self.should_merge(metas) or tiny >= self.min_merge >= 2

    def pick(self, metas: list[Meta], n: int = 0) -> list[Meta]:
        """The n smallest by live documents, then by id; none if there are fewer."""
        n = max(2, n if n > 0 else self.min_merge)
        return sorted(metas, key=lambda m: (m.doc_count, m.id))[:n] if len(metas) >= n else []

    def plan(self, metas: list[Meta], next_id: int) -> tuple[list[int], int] | None:
        """(source ids, target id), or None where nothing needs merging."""
        sources = self.pick(metas, self.min_merge) if self.should_merge(metas) else []
        return ([m.id for m in sources], next_id) if len(sources) >= 2 else None


def select_ids(metas: list[Meta], ids: list[int]) -> list[Meta]:
    return [m for m in metas if m.id in set(ids)]


def exclude_ids(metas: list[Meta], ids: list[int]) -> list[Meta]:
    return [m for m in metas if m.id not in set(ids)]


class SegmentSet:
    """Segments by id, in the order in which they were added, over the tables live and tombstones of all of them."""

    def __init__(self, live: DataFrame, tombstones: DataFrame, metas: list[Meta] = ()):
        self.live, self.tombstones, self._metas = live, tombstones, [m for m in metas if m is not None]

    def add(self, meta: Meta | None) -> None:
        if meta is not None:
            self._metas.append(meta)

    def all(self) -> list[Meta]:
        return list(self._metas)

    def __len__(self) -> int:
        return len(self._metas)

    def ids(self) -> list[int]:
        return sorted(m.id for m in self._metas)

    def find(self, segment_id: int) -> Meta | None:
        return next((m for m in self._metas if m.id == segment_id), None)

    def remove(self, segment_id: int) -> bool:
        """Whether there was one."""
        before = len(self._metas)
        self._metas = exclude_ids(self._metas, [segment_id])
        return len(self._metas) < before

    def total_docs(self) -> DataFrame:
        """One row: how many documents live in any of the segments, each counted once."""
        return estimate_merged(self.live.where(F.col("segment_id").isin(*self.ids())), self.tombstones)


class Builder:
    """Collects documents and their terms on the driver for a small segment; large ones come from `build` over tables."""

    def __init__(self) -> None:
        self._docs: dict[int, set[str]] = {}

    def add_doc(self, doc_id: int, terms: list[str]) -> None:
        """A document that is there already gets the terms as well."""
        self._docs.setdefault(doc_id, set()).update(t for t in terms if t)

    def delete_doc(self, doc_id: int) -> None:
        self._docs.pop(doc_id, None)

    def doc_count(self) -> int:
        return len(self._docs)

    def build(self, spark: SparkSession, segment_id: int) -> tuple[DataFrame, DataFrame]:
        """(live, postings) of the segment."""
        live = spark.createDataFrame([(segment_id, d) for d in self._docs], "segment_id long, doc_id long")
        rows = [(segment_id, d, t) for d, terms in self._docs.items() for t in sorted(terms)]
        return live, spark.createDataFrame(rows, "segment_id long, doc_id long, term string")


def dir_name(segment_id: int) -> str:
    return f"seg-{segment_id:016x}"


def score_segment(doc_count: Column, term_count: Column) -> Column:
    """Merge priority: smaller goes first."""
    return doc_count * 10 + term_count


def alive(table: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows of table that no tombstone names. They are dealt out by doc_id alone, so what follows by doc_id needs no
    second shuffle, and not sorted: a task holds its share of the tombstones (segment_id stands outside the join's keys for that)."""
    dead = tombstones.select(F.col("segment_id").alias("_segment"), F.col("doc_id").alias("_doc")).hint("shuffle_hash")
    return table.join(dead, (F.col("doc_id") == F.col("_doc")) & (F.col("segment_id") - F.col("_segment") == 0), "left_anti")


def build(live: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of live documents with a term, each once."""
    return postings.where("term <> ''").dropDuplicates([*KEY, "term"]).join(live.select(*KEY), KEY, "left_semi")


def metas(live: DataFrame, postings: DataFrame) -> DataFrame:
    """A row for each segment: segment_id, doc_count, min_doc, max_doc, term_count."""
    docs = live.groupBy("segment_id").agg(F.countDistinct("doc_id").alias("doc_count"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))
    terms = postings.groupBy("segment_id").agg(F.countDistinct("term").alias("term_count"))
    return docs.join(terms, "segment_id", "left").withColumn("term_count", F.coalesce("term_count", F.lit(0)))


def merge(live: DataFrame, postings: DataFrame, tombstones: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """(live, postings) of one segment: the union of what lives in the given ones; a document in two has all its terms."""
    one = F.lit(target).cast("long").alias("segment_id")
    docs = alive(live, tombstones).select(one, "doc_id").distinct()
    rows = alive(postings, tombstones).select(one, "doc_id", "term").distinct()
    return docs, rows


def estimate_merged(live: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row, docs: how many documents a merge would have."""
    return alive(live, tombstones).agg(F.countDistinct("doc_id").alias("docs"))


def dry_run(live: DataFrame, postings: DataFrame) -> DataFrame:
    """What a merge of all given segments would give: one row of counts and bounds."""
    one = F.lit(1).alias("one")
    docs = live.agg(F.countDistinct("doc_id").alias("doc_count"), F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))
    terms = postings.agg(F.countDistinct("term").alias("term_count"))
    return docs.select("*", one).join(terms.select("*", one), "one").drop("one")


def duplicates(postings: DataFrame) -> DataFrame:
    """Pairs that a segment holds more than once; a valid one has none."""
    return postings.groupBy(*KEY, "term").agg(F.count("*").alias("n")).where("n > 1")


def merge_problems(live: DataFrame, postings: DataFrame, tombstones: DataFrame, out_live: DataFrame, out_postings: DataFrame) -> DataFrame:
    """(problem, doc_id, term): what a merged segment lost, made up or holds twice; none for a right merge."""
    want_docs = alive(live, tombstones).select("doc_id").distinct()
    no_term, pair = F.lit(None).cast("string").alias("term"), ["doc_id", "term"]
    docs = want_docs.join(out_live, "doc_id", "left_anti").select(F.lit("missing document").alias("problem"), "doc_id", no_term)
    docs = docs.unionByName(out_live.join(want_docs, "doc_id", "left_anti").select(F.lit("unexpected document").alias("problem"), "doc_id", no_term))
    # both sides' postings are counted in one pass: how often a pair is wanted, how often it is there, and in how many segments more than once
    number = lambda n: F.lit(n).cast("long")
    wanted = alive(postings, tombstones).select(*pair, number(1).alias("want"), number(0).alias("n"), number(0).alias("twice"))
    held = out_postings.groupBy("doc_id", "term", "segment_id").agg(F.count("*").alias("n")).select(*pair, number(0).alias("want"), "n", F.when(F.col("n") > 1, 1).otherwise(0).cast("long").alias("twice"))
    both = wanted.unionByName(held).groupBy(*pair).agg(*[F.sum(c).alias(c) for c in ("want", "n", "twice")]).where("want = 0 or n = 0 or twice > 0")
    times = lambda problem, n: F.array_repeat(F.lit(problem), n.cast("int"))
    found = F.concat(
        times("missing posting", F.when(F.col("n") == 0, 1).otherwise(0)),
        times("unexpected posting", F.when(F.col("want") == 0, F.col("n")).otherwise(0)),
        times("repeated posting", F.col("twice")),
    )
    return docs.unionByName(both.select(F.explode(found).alias("problem"), *pair))


def verify_merge(*tables: DataFrame) -> None:
    bad = merge_problems(*tables).limit(5).collect()
    if bad:
        raise SegmentError(f"merge is wrong: {bad}")
