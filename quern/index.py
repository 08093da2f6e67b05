"""SearchIndex: add, delete, flush, search. All data is in tables; the driver holds a manifest and unflushed single changes.

Published state is what the manifest names. Every change writes new files first, then the manifest, and
deletes old files last; so a crash leaves the old state or the new one, and files nobody names. A batch of
changes counts once its mark stands beside it in the log, with its rows' number and checksum, which are
compared when the index is opened; a batch without a mark was cut short and is ignored.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.arrays import counted
from quern.operators import segments as seg
from quern.operators import stats
from quern.operators.analysis import DEFAULT, count_tokens, term_freq, term_lists
from quern.plans import compile as plan
from quern.plans.query import Query, normal, optimize, parse
from quern.sources import changes as log
from quern.sources.store import Store, reading, spread


class EmptyQuery(ValueError):
    pass


class IndexClosed(RuntimeError):
    pass


class InvalidDocument(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    analyzer: object = field(default=DEFAULT)
    flush_threshold: int = 256
    merge_policy: seg.Policy = seg.Policy()
    wal: bool = True
    stats: bool = True
    max_hits: int = 10_000

    def __post_init__(self) -> None:
        for name, least in (("flush_threshold", 256), ("max_hits", 10_000)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, least)
        if self.analyzer is None:
            object.__setattr__(self, "analyzer", DEFAULT)


DOCS, POSTINGS = "segment_id long, doc_id long, text string, length long", "segment_id long, doc_id long, term string, tf long"
#: What is stored of a document: its text and the terms of its text with their counts, from which postings are made.
STORED = f"{DOCS}, counts array<struct<term: string, tf: bigint>>"
DEAD = "segment_id long, doc_id long"
#: Bytes of a row group of texts, and of what one task reads when a segment is written: they bound what it sorts, whatever the corpus.
GROUP, READ = 16 << 20, 32 << 20
#: Tombstones whose files have no more bytes go to all executors; others are joined by shuffles.
FEW = 8 << 20


class SearchIndex:
    """Open with SearchIndex(spark, root, **options of Options); `with` closes it."""

    def __init__(self, spark: SparkSession, root: str, **options):
        self.spark, self.options = spark, Options(**options)
        self.store = Store(spark, root)
        self.manifest = self.store.load_manifest()
        self._single: list[tuple[int, int, int, str]] = []
        self._batches: list[str] = []
        self.closed = False
        self.recover()

    def recover(self) -> None:
        """Read what the log holds beyond the manifest. A torn or altered batch or record is an error, an unfinished one none."""
        seq, self.last_batch = self.manifest["next_seq"], self.manifest["last_batch"]
        names, first = self.store.names("log"), self.manifest["log_from"]
        numbered = {n: int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit()}
        for name in (n for n, k in numbered.items() if k >= first):
            if name.endswith(".log"):
                for r in log.replay(self.store.read_bytes(f"log/{name}")):
                    self._single.append((r["seq"], r["op"], r["doc_id"], r["text"]))
                    seq = max(seq, r["seq"] + 1)
            elif name.endswith(".mark"):
                mark, batch = json.loads(self.store.read_bytes(f"log/{name}")), name.removesuffix(".mark")
                if log.fingerprint(self._logged([batch])) != tuple(mark["fingerprint"]):
                    raise log.CorruptLog(f"batch {batch} is not what was logged", [])
                self._batches.append(batch)
                seq, self.last_batch = max(seq, mark["next_seq"]), max(self.last_batch, mark["stream_batch"])
        self._seq = seq
        self._next_log = max([self.manifest["next_log"], *(k + 1 for k in numbered.values())])

    open = classmethod(lambda cls, spark, root, **options: cls(spark, root, **options))

    def __enter__(self) -> SearchIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Idempotent. Unflushed changes stay in the log; without one they are lost."""
        self.closed = True

    @property
    def root(self) -> str:
        return self.store.root

    def _open(self) -> None:
        if self.closed:
            raise IndexClosed("the index is closed")

    # Writing

    def add(self, doc_id: int, text: str) -> None:
        """Insert or replace one document."""
        self._change(log.ADD, doc_id, text)
        if len({x[2] for x in self._single if x[1] == log.ADD}) >= self.options.flush_threshold and self.mem_doc_count() >= self.options.flush_threshold:
            self.flush()

    def delete(self, doc_id: int) -> None:
        """Delete one document; an unknown id is no error. `has_doc` tells beforehand whether there is one."""
        self._change(log.DELETE, doc_id, "")

    def _change(self, op: int, doc_id: int, text: str) -> None:
        self._open()
        if not 0 < doc_id < 1 << 63:
            raise InvalidDocument(f"document id {doc_id}")
        if self.options.wal:
            name = f"log/{self._next_log:012d}.log"
            payload = json.dumps({"seq": self._seq, "op": op, "doc_id": doc_id, "text": text}, ensure_ascii=False)
            self.store.write_bytes(name, log.frame(payload.encode()))
            self._next_log += 1
        self._single.append((self._seq, op, doc_id, text))
        self._seq += 1

    @property
    def log_path(self) -> str:
        """The folder of the change log."""
        return self.store.full("log")

    def apply(self, changes: DataFrame, stream_batch: int = -1) -> None:
        """Log a batch of changes (op, doc_id, text, and optionally seq within the batch).

        Without seq all changes of the batch are simultaneous: of several for one id, a delete counts, then
        the largest text. Ids that are null or not positive are refused. An empty batch leaves only its mark.
        """
        self._open()
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        rows = changes.select(seq.alias("seq"), F.col("op").cast("int").alias("op"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        name = f"{self._next_log:012d}"
        checked = rows.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")).otherwise(F.raise_error(F.lit("document ids are positive"))))
        checked.withColumn("seq", F.col("seq") + self._seq).write.mode("overwrite").option("parquet.block.size", GROUP).parquet(self.store.full(f"log/{name}"))
        count, last, total = log.fingerprint(self._logged([name]))
        mark = {"fingerprint": [count, last, total], "next_seq": max(self._seq, last + 1), "stream_batch": stream_batch}
        self.store.write_bytes(f"log/{name}.mark", json.dumps(mark).encode())
        self._next_log += 1
        self._batches.append(name)
        self._seq, self.last_batch = mark["next_seq"], max(self.last_batch, stream_batch)

    def add_all(self, docs: DataFrame) -> None:
        """Insert or replace docs(doc_id, text) as one batch."""
        self.apply(docs.select(F.lit(log.ADD).alias("op"), "doc_id", "text"))

    def delete_all(self, ids: DataFrame) -> None:
        self.apply(ids.select(F.lit(log.DELETE).alias("op"), "doc_id", F.lit("").alias("text")))

    # Reading

    def _logged(self, names: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(log.SCHEMA).parquet(*[self.store.full(f"log/{n}") for n in names or self._batches])

    def changes(self) -> DataFrame:
        """Unflushed changes."""
        rows = self.spark.createDataFrame(self._single, log.SCHEMA)
        return rows.unionByName(self._logged()) if self._batches else rows

    def _table(self, kind: str, schema: str, ids: list[int] | None = None) -> DataFrame:
        names = [seg.dir_name(m["id"]) for m in self.manifest["segments"] if ids is None or m["id"] in ids]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.store.full(f"segments/{n}/{kind}") for n in names])

    def tombstones(self) -> DataFrame:
        names = self.manifest["tombstones"]
        return self.spark.read.schema(DEAD).parquet(*[self.store.full(f"tombstones/{n}") for n in names]) if names else self.spark.createDataFrame([], DEAD)

    def _alive(self, table: DataFrame) -> DataFrame:
        names = self.manifest["tombstones"]
        if not names:
            return table
        few = sum(self.store.size(f"tombstones/{n}") for n in names) <= FEW
        return table.join(F.broadcast(self.tombstones()), seg.KEY, "left_anti") if few else seg.alive(table, self.tombstones())

    def _published(self, table: DataFrame) -> DataFrame:
        table = self._alive(table)
        if self._single or self._batches:
            table = table.join(log.changed(self.changes()), "doc_id", "left_anti")
        return table

    def _stored(self, ids: list[int] | None = None) -> DataFrame:
        """The documents of segments, with their terms and counts. In an index from before `counts` was stored, they come from the postings."""
        if self.manifest["format"] > 1:
            return self._table("docs", STORED, ids)
        lists = self._table("postings", POSTINGS, ids).groupBy(*seg.KEY).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("counts"))
        return self._table("docs", DOCS, ids).join(lists, seg.KEY, "left")

    def live_docs(self) -> DataFrame:
        """(doc_id, text, length) of all live documents, those without terms too."""
        docs = self._published(self._table("docs", DOCS)).select("doc_id", "text", "length")
        if self._single or self._batches:
            fresh = log.live(self.changes())
            docs = docs.unionByName(fresh.select("doc_id", "text", F.size(self.options.analyzer.list(F.col("text"))).cast("long").alias("length")))
        return docs

    def live_tf(self) -> DataFrame:
        """(doc_id, term, tf) of all live documents."""
        rows = self._published(self._table("postings", POSTINGS)).select("doc_id", "term", "tf")
        return rows.unionByName(term_freq(log.live(self.changes()), self.options.analyzer)) if self._single or self._batches else rows

    def all_tf(self) -> DataFrame:
        """The rows of live_tf from the documents' side: for those who read all terms. Tombstones meet documents, not postings."""
        rows = self._published(self._stored().select("segment_id", "doc_id", "counts")).select("doc_id", F.inline("counts"))
        return rows.unionByName(term_freq(log.live(self.changes()), self.options.analyzer)) if self._single or self._batches else rows

    def posting(self, term: str) -> DataFrame:
        """doc_id of the live documents with the normalized term."""
        return self.live_tf().where(F.col("term") == normal(term)).select("doc_id")

    def snapshot(self) -> Snapshot:
        """The state as it is now; later changes do not show in it (until their flush or merge removes its files)."""
        self._open()
        return Snapshot(self.live_tf(), self.live_docs())

    def segment(self, segment_id: int) -> Segment:
        """One published segment, less its tombstones."""
        meta = self.segments().find(segment_id)
        if meta is None:
            raise KeyError(f"no segment {segment_id}")
        return Segment(meta, self._alive(self._table("docs", DOCS, [segment_id])), self._alive(self._table("postings", POSTINGS, [segment_id])), self._alive(self._stored([segment_id])))

    def segments(self) -> seg.SegmentSet:
        return seg.SegmentSet(self._table("docs", DOCS), self.tombstones(), self.segment_metas())

    def has_doc(self, doc_id: int) -> bool:
        return not self.live_docs().where(F.col("doc_id") == doc_id).isEmpty()

    def _ready(self, q: Query | str | None) -> Query:
        q = parse(q) if isinstance(q, str) else q
        if q is None or q.is_empty():
            raise EmptyQuery("the query is empty")
        self._open()
        q = optimize(q)
        if q is None:
            raise EmptyQuery("the query is empty")
        return q

    def search(self, q: Query | str, scorer: str = "tf", limit: int | None = None) -> DataFrame:
        """Ranked hits (doc_id, score), max_hits at most. scorer: tf (summed frequencies) or bm25; without stats every score is 1."""
        q = self._ready(q)
        tf, docs = self.live_tf(), self.live_docs()
        ids = plan.matching(q, tf, docs)
        if not self.options.stats:
            hits = ids.withColumn("score", F.lit(1.0))
        else:
            scores = plan.weighted_tf(q, tf) if scorer == "tf" else stats.bm25_scores(tf, docs.select("doc_id", "length"), list(plan.term_weights(q)))
            hits = ids.join(scores, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return plan.ranked(hits, limit or self.options.max_hits)

    def search_doc_ids(self, q: Query | str, limit: int | None = None) -> DataFrame:
        """The ids of all matching documents, in id order: max_hits cuts a ranking, and none is needed here. limit: those of the best hits only."""
        ids = self.search(q, limit=limit) if limit else plan.matching(self._ready(q), self.live_tf(), self.live_docs())
        return plan.in_order(ids)

    def brute_force(self, q: Query | str) -> DataFrame:
        """doc_id of matching documents by analysing every text: no index, no score, no limit."""
        q = parse(q) if isinstance(q, str) else q
        if q is None or q.is_empty():
            raise EmptyQuery("the query is empty")
        self._open()
        lists = term_lists(self.live_docs().select("doc_id", "text"), self.options.analyzer)
        return plan.in_order(lists.where(plan.predicate(optimize(q), F.col("terms"))))

    def doc_text(self, doc_id: int) -> str | None:
        row = self.live_docs().where(F.col("doc_id") == doc_id).select("text").first()
        return row and row[0]

    def stats_snapshot(self, top_k: int = 20) -> DataFrame:
        return stats.snapshot(self.all_tf(), self.live_docs().select("doc_id", "length"), top_k)

    def mem_doc_count(self) -> int:
        return log.live(self.changes()).count() if self._single or self._batches else 0

    def segment_count(self) -> int:
        return len(self.manifest["segments"])

    def segment_metas(self) -> list[seg.Meta]:
        return [seg.Meta(**m) for m in self.manifest["segments"]]

    def info(self) -> str:
        return f"root={self.root} segs={self.segment_count()} mem_docs={self.mem_doc_count()} texts={self.live_docs().count()}"

    # Publishing

    def _write_segment(self, segment_id: int, docs: DataFrame) -> seg.Meta | None:
        """Write docs(doc_id, text, length, counts), each id once, and their postings; None if there are no documents.

        Postings are sorted by term within a file, and a file has those of some 16 MB of texts: nothing is shuffled.
        """
        at = f"segments/{seg.dir_name(segment_id)}"
        one = F.lit(segment_id).cast("long").alias("segment_id")
        docs.select(one, "doc_id", "text", "length", "counts").write.mode("overwrite").option("parquet.block.size", GROUP).parquet(self.store.full(f"{at}/docs"))
        stored = self.spark.read.schema(STORED).parquet(self.store.full(f"{at}/docs"))
        stored.select("segment_id", "doc_id", F.inline("counts")).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(self.store.full(f"{at}/postings"))
        n, low, high = stored.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
        terms = self.spark.read.schema(POSTINGS).parquet(self.store.full(f"{at}/postings")).select("term").distinct().count()
        return seg.Meta(segment_id, n, low, high, terms, int(time.time())) if n else None

    def flush(self) -> None:
        """Publish all changes as one segment and tombstones; then merge at most once."""
        self._open()
        if not self._single and not self._batches:
            return
        with reading(self.spark, READ):
            self._flush()
            self._maybe_merge()

    def _flush(self) -> None:
        m, segment_id = self.manifest, self.manifest["next_id"]
        changes, ids = self.changes(), log.changed(self.changes())
        size = sum(self.store.size(f"log/{n}") for n in self._batches)
        # a batch that changes no document twice is written as it is, without a shuffle of its texts
        latest = log.valid(changes) if ids.groupBy("doc_id").count().where("count > 1").isEmpty() else log.latest(spread(changes, size, "doc_id"))
        fresh = latest.where(F.col("op") == log.ADD).withColumn("terms", self.options.analyzer.list(F.col("text")))
        meta = self._write_segment(segment_id, fresh.select("doc_id", "text", F.size("terms").cast("long").alias("length"), counted(F.col("terms")).alias("counts")))
        dead = self._alive(self._table("docs", DOCS).select(*seg.KEY)).join(ids, "doc_id", "left_semi").select("segment_id", "doc_id")
        tomb = f"{segment_id:016x}"
        dead.write.mode("overwrite").parquet(self.store.full(f"tombstones/{tomb}"))
        lost = {r["segment_id"]: r["n"] for r in self.spark.read.schema(DEAD).parquet(self.store.full(f"tombstones/{tomb}")).groupBy("segment_id").agg(F.count("*").alias("n")).collect()}
        old = [vars(replace(seg.Meta(**x), doc_count=x["doc_count"] - lost.get(x["id"], 0))) for x in m["segments"]]
        done = m | {
            "next_id": segment_id + 1,
            "segments": old + ([vars(meta)] if meta else []),
            "tombstones": m["tombstones"] + [tomb] * bool(lost),
            "log_from": self._next_log,
            "next_log": self._next_log,
            "next_seq": self._seq,
            "last_batch": self.last_batch,
        }
        self.store.save_manifest(done)
        if not lost:
            self.store.remove(f"tombstones/{tomb}")
        consumed = [n for n in self.store.names("log") if n.split(".")[0].isdigit() and int(n.split(".")[0]) < self._next_log]
        self.manifest, self._single, self._batches = done, [], []
        for n in consumed:
            self.store.remove(f"log/{n}")

    def compact(self) -> bool:
        """Merge once if the policy asks for it; whether it did."""
        self._open()
        with reading(self.spark, READ):
            return self._maybe_merge()

    def _maybe_merge(self) -> bool:
        policy, metas = self.options.merge_policy, self.segment_metas()
        if not policy.needs_compaction(metas):
            return False
        chosen = policy.plan(metas, self.manifest["next_id"])
        ids = chosen[0] if chosen else [x.id for x in policy.pick(metas, 2)]
        if len(ids) < 2:
            return False
        target = self.manifest["next_id"]
        dead = self.tombstones()
        meta = self._write_segment(target, self._alive(self._stored(ids)))  # an id lives in one segment only: a flush buries its older versions
        rest = [vars(x) for x in seg.exclude_ids(metas, ids)]
        # tombstones of what stays are written anew, so that they never outlive their segments
        stays, old = [x["id"] for x in rest], self.manifest["tombstones"]
        name = f"{target:016x}"
        if stays and old:
            dead.where(F.col("segment_id").isin(*stays)).coalesce(1).write.mode("overwrite").parquet(self.store.full(f"tombstones/{name}"))
        done = self.manifest | {"next_id": target + 1, "segments": rest + ([vars(meta)] if meta else []), "tombstones": [name] if stays and old else []}
        self.store.save_manifest(done)
        self.manifest = done
        for x in ids:
            self.store.remove(f"segments/{seg.dir_name(x)}")
        for x in old:
            self.store.remove(f"tombstones/{x}")
        return True


@dataclass(frozen=True)
class Snapshot:
    """tf(doc_id, term, tf) and docs(doc_id, text, length) of a moment."""

    tf: DataFrame
    docs: DataFrame

    def posting(self, term: str) -> DataFrame:
        """doc_id of the documents with exactly this term; it is not normalized."""
        return self.tf.where(F.col("term") == term).select("doc_id")

    def doc_count(self) -> int:
        return self.docs.count()

    def is_live(self, doc_id: int) -> bool:
        return not self.docs.where(F.col("doc_id") == doc_id).isEmpty()


@dataclass(frozen=True)
class Segment:
    """One published segment: its catalog entry, and its live documents and postings."""

    meta: seg.Meta
    docs: DataFrame
    postings: DataFrame
    stored: DataFrame

    def posting(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id")

    def terms(self) -> DataFrame:
        return self.stored.select(F.inline("counts")).select("term").distinct()

    def live_docs(self) -> DataFrame:
        return self.docs.select("doc_id")

    def is_live(self, doc_id: int) -> bool:
        return not self.docs.where(F.col("doc_id") == doc_id).isEmpty()

    def all_postings(self) -> DataFrame:
        """(term, doc_id) for every live document's terms."""
        return self.stored.select("doc_id", F.inline("counts")).select("term", "doc_id")
