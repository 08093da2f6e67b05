"""Substring dedup over a log-structured fingerprint index.

A window is `window` consecutive words of one document; a word is removed if a window over it also
starts in a document with a smaller id (windows are judged on the input). The hash of a window is the
smallest hash of the `gram`-word grams inside it, so equal windows have equal hashes, and neighbouring
windows share theirs: the index has one row (key, doc, at) for all windows that the same gram stands for.

The index is a folder with a manifest, which is replaced atomically:
- runs: immutable, dealt to `buckets` files by key and sorted by key in each. A new batch becomes a run of
  level 0; `fanout` runs of a level are compacted into one of the next.
- texts: the compressed texts of each batch, dealt by document, from which words are verified later.
Runs and texts are Spark's bucketed tables, so joining them by key or document moves no row of theirs.

A batch goes through four steps:
1. Its texts and its run are written.
2. Merge: the new run meets itself and the historical runs, in key order. Keys that two documents share
   make candidates, in the batch and in history.
3. Verify: windows around candidates meet by a 94-bit digest of their words; a window of the batch
   whose digest starts in a smaller document is a repeat. Equal windows of a task's flush are one row
   beforehand, so a passage in very many documents costs a row for each flush.
4. Remove: every text of the batch loses the words that repeats cover.

Very frequent grams: keys with more than a fraction of an average task's rows are salted by document over
several tasks and kept by name in a small table beside the run. Nothing is capped.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm._common import cleaned, partitions, scratch, slices, staged
from quern.sources.store import Store

LAST = (1 << 63) - 1  # stands for a null id: one document after all others
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
NEXT_SPACE = re.compile(rb"[ \t-\r]")
LONGEST = 64  # words of more bytes are hashed one by one


def _letters() -> np.ndarray:
    """A random value for each byte at each place of a word; none for white space."""
    x = np.arange(1, LONGEST * 256 + 1, dtype=np.uint64) * FACTORS[0]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    x.reshape(LONGEST, 256)[:, SPACE] = 0
    return x


LETTERS = _letters()


def _piece(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first bytes) of the words of a piece, which white space ends: the sum of their letters' values."""
    white = SPACE[b]
    before = np.concatenate(([True], white[:-1]))
    starts = np.flatnonzero(before & ~white)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    ends = np.flatnonzero(white & ~before)
    at = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
    np.minimum(at, LONGEST - 1, out=at)
    h = np.add.reduceat(LETTERS[at * 256 + b[starts[0] :]], starts - starts[0])
    for i in np.flatnonzero(ends - starts > LONGEST).tolist():
        h[i] = xxhash.xxh3_64_intdigest(b[starts[i] : ends[i]].tobytes())
    return h, starts


def word_hashes(texts: list[bytes], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, end to end; number of words of each text)."""
    buf = b"\n".join([*texts, b""])
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(buf):
        end = len(buf) if at + piece >= len(buf) else NEXT_SPACE.search(buf, at + piece).end()
        h, first = _piece(np.frombuffer(buf, np.uint8, end - at, at))
        hashes.append(h)
        starts.append(first + at)
        at = end
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), bounds))


def rolling(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A hash of the n words from each position on; positions too near the end have none."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = out * factor + h[j : len(h) - n + 1 + j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(h: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat positions of grams that anchor a window, their hashes); all of equal ones."""
    grams = rolling(h, gram, FACTORS[0]) | np.uint64(1)
    starts = len(h) - window + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    span = window - gram + 1
    low = grams[:starts].copy()
    for j in range(1, span):
        np.minimum(low, grams[j : j + starts], out=low)
    ends = np.repeat(np.cumsum(lengths), lengths)[:starts]
    low[np.arange(starts) + window > ends] = 0
    hit = np.zeros(len(grams), bool)
    for j in range(span):
        hit[j : j + starts] |= low == grams[j : j + starts]
    places = np.flatnonzero(hit)
    return places, grams[places]


OFTEN = 8  # a key that comes so often in a flush is counted; a key's other rows are fewer than this by flush


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int, flush_rows: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """(key, doc, at) for each gram that stands for a window, and (key, count, -1) for keys that come often in a flush."""
    held: list[np.ndarray] = []

    def rows(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(at.astype(np.int32))], ["key", "doc", "at"])

    def often() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        at = np.flatnonzero(n >= OFTEN)
        return rows(keys[at], n[at].astype(np.int64), np.full(len(at), -1))

    for batch in batches:
        for part in slices(batch, "text"):
            h, lengths = word_hashes(part.column("text").cast(pa.binary()).fill_null(b"").to_pylist())
            places, keys = anchors(h, lengths, window, gram)
            starts = np.cumsum(lengths) - lengths
            owner = np.searchsorted(starts + lengths, places, "right")
            yield rows(keys, part.column("doc").to_numpy(zero_copy_only=False)[owner], places - starts[owner])
            held.append(keys)
            if sum(map(len, held)) >= flush_rows:
                yield often()
                held = []
    if held:
        yield often()


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in slices(batch, "text"):
            z = [press(x) for x in part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("tag"), pa.array(z, pa.binary())], ["doc", "tag", "z"])


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


WINDOWS = "h long, v long, doc long, tag long"
FRESH, KNOWN, OLD = 0, 1, 2  # to be decided; a repeat already; of history, which only tells what is there
#: h has 64 bits of a window's digest; v has 30 more, then 32 for the window's place and 2 for its kind.
PLACE = 34


def _packed(h2: np.ndarray, at: np.ndarray, kind: int) -> np.ndarray:
    return h2 << PLACE | at << 2 | kind


def _lowest(h: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order by window and document, the smallest document of each row's window in that order)."""
    order = np.lexsort((doc, h2, h))
    h, h2, doc = h[order], h2[order], doc[order]
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])))
    return order, doc[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int, kind: int, flush_rows: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """(doc, tag, z, places) -> a 94-bit digest of the words of each window around a place. Of equal windows of a flush,
    only those of the smallest document go on; the others are repeats already."""
    held: list[tuple] = []
    size = 0

    def rows(h, v, doc, tag) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, v, doc, tag)], ["h", "v", "doc", "tag"])

    def flush() -> Iterator[pa.RecordBatch]:
        h, h2 = np.frombuffer(b"".join([x[0] for x in held]), "<i8").reshape(-1, 2).T
        h2 = h2 << PLACE >> PLACE  # the bits that a row has room for
        n = [len(x[3]) for x in held]
        doc, tag, at = np.repeat([x[1] for x in held], n), np.repeat([x[2] for x in held], n), np.concatenate([x[3] for x in held])
        order, low = _lowest(h, h2, doc)
        first = doc[order] == low
        own = order[first]
        yield rows(h[own], _packed(h2[own], at[own], kind), doc[own], tag[own])
        if kind == FRESH and not first.all():  # a repeat need not meet its like, so it goes anywhere; its document's stay together
            again = np.sort(order[~first])
            yield rows(doc[again] * np.int64(-7046029254386353131), _packed(np.zeros(len(again), np.int64), at[again], KNOWN), doc[again], tag[again])

    for batch in batches:
        for doc, tag, z, places in zip(*(batch.column(c) for c in ("doc", "tag", "z", "places"))):
            words = _unpack(z.as_py()).split()
            n = len(words) - window + 1  # starts of windows
            if n <= 0:
                continue
            at = places.values.to_numpy(zero_copy_only=False)
            at = at[at < len(words)]
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(at - (window - gram), 0), 1)
            np.subtract.at(near, at + 1, 1)
            at = np.flatnonzero(np.cumsum(near)[:n] > 0)
            if not len(at):
                continue
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            del words
            starts = np.concatenate(([0], ends[:-1]))
            digest = xxhash.xxh3_128_digest
            held.append((b"".join([digest(joined[i:j]) for i, j in zip(starts[at].tolist(), (ends[at + window - 1] - 1).tolist())]), doc.as_py(), tag.as_py(), at))
            size += len(at)
            if size >= flush_rows:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _window_rows sorted by h -> (doc, tag, at): windows that also start in a smaller document."""

    def closed(h, v, doc, tag) -> pa.RecordBatch:
        known = v & 3 == KNOWN
        order, low = _lowest(h, v >> PLACE, np.where(known, LAST, doc))
        v, doc, tag, known = v[order], doc[order], tag[order], known[order]
        keep = known | ((v & 3 == FRESH) & (doc > low))
        at = v[keep] >> 2 & (1 << PLACE - 2) - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(tag[keep]), pa.array(at.astype(np.int32))], ["doc", "tag", "at"])

    held = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        h = held[0]
        if len(h) > 100_000 and h[0] != h[-1]:
            last = int(np.flatnonzero(h != h[-1])[-1]) + 1
            yield closed(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if held is not None and held[0].size:
        yield closed(*held)


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc, tag, z, covered) -> what each text keeps; covered has the tags and starts of its document's repeats."""
    for batch in batches:
        sizes, removed, shas = [], [], []
        tags = batch.column("tag").to_pylist()
        for i, (z, covered) in enumerate(zip(batch.column("z"), batch.column("covered"))):
            words = _unpack(z.as_py()).split()
            sizes.append(len(words))
            gone = 0
            if covered.is_valid:
                tag, at = (covered.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                at = at[tag == tags[i]].astype(np.int64)
                cover = np.zeros(len(words) + window + 1, np.int64)
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + window, 1)
                keep = np.cumsum(cover)[: len(words)] == 0
                gone = int(len(words) - keep.sum())
                words = [w for w, k in zip(words, keep.tolist()) if k]
            removed.append(gone)
            shas.append(_digest(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc", "n_words", "n_removed", "kept_sha256"])


RUN, TEXTS, HOT = "key long, doc long, at int, hot boolean", "doc long, tag long, z binary", "key long, salts int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SubstringIndex:
    """Opens the index in a shared folder, or makes a new one there."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, window: int = 13, gram: int = 4, fanout: int = 2, hot_share: int = 8):
        self.spark, self.store, self.fanout, self.hot_share = spark, Store(spark, path or scratch(spark, "substring-index")), fanout, hot_share
        new = {"next": 1, "buckets": partitions(spark), "window": window, "gram": gram, "runs": [], "texts": []}
        self.manifest = json.loads(self.store.read_bytes("manifest.json")) if self.store.exists("manifest.json") else new
        self.window, self.gram, self.buckets = (self.manifest[k] for k in ("window", "gram", "buckets"))
        self._tables: dict[str, str] = {}

    @property
    def runs(self) -> list[dict]:
        return self.manifest["runs"]

    def _publish(self, **changes) -> None:
        manifest = self.manifest | changes
        self.store.write_bytes("manifest.json", json.dumps(manifest).encode())
        self.manifest = manifest

    def _write(self, rows: DataFrame, name: str, by: str) -> None:
        """A bucketed table of one sorted file for each bucket; what a cut-off attempt left under the name goes first."""
        self.store.remove(name)
        table = f"substring_{uuid.uuid4().hex}"
        with cleaned(self.spark):
            rows.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by).format("parquet").option("path", self.store.full(name)).saveAsTable(table)
        self._tables[name] = table

    def _read(self, name: str, schema: str, by: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = f"substring_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self._tables[name]} ({schema}) using parquet clustered by ({by}) sorted by ({by}) into {self.buckets} buckets location '{self.store.full(name)}'")
        return self.spark.table(self._tables[name])

    def _forget(self, name: str) -> None:
        if table := self._tables.pop(name, None):
            self.spark.sql(f"drop table if exists {table}")
        self.store.remove(name)

    def drop(self) -> None:
        """Delete the index."""
        for name in list(self._tables):
            self._forget(name)
        self.store.remove("")

    def _run(self, run: dict) -> DataFrame:
        return self._read(run["name"], RUN, "key")

    def _hot(self, run: dict) -> DataFrame:
        return self.spark.read.schema(HOT).parquet(self.store.full(run["name"] + "-hot"))

    def _write_run(self, rows: DataFrame, hot: DataFrame, level: int, number: int) -> dict:
        name = f"run-{number:06d}"
        self._write(rows.select("key", "doc", "at", "hot"), name, "key")
        hot.coalesce(1).write.mode("overwrite").parquet(self.store.full(name + "-hot"))
        return {"name": name, "level": level, "hot": self._hot({"name": name}).count()}

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next. The old ones go once the manifest names the new one."""
        old = [r for r in self.runs if r["level"] == level]
        rows = reduce(DataFrame.unionByName, map(self._run, old))
        hot = reduce(DataFrame.unionByName, map(self._hot, old)).groupBy("key").agg(F.max("salts").alias("salts"))
        run = self._write_run(rows, hot, level + 1, self.manifest["next"])
        self._publish(next=self.manifest["next"] + 1, runs=[r for r in self.runs if r not in old] + [run])
        for r in old:
            self._forget(r["name"])
            self.store.remove(r["name"] + "-hot")

    def _new_run(self, texts: DataFrame) -> dict:
        rows = texts.select("doc", "text").mapInArrow(partial(_anchor_rows, window=self.window, gram=self.gram), "key long, doc long, at int")
        rows = staged(rows, "substring-anchors")
        limit = max(4 * OFTEN, rows.where("at >= 0").count() // (self.hot_share * self.buckets))
        often = rows.where("at < 0").groupBy("key").agg(F.sum("doc").alias("n")).where(F.col("n") > limit)
        hot = staged(often.select("key", F.ceil(F.col("n") / limit).cast("int").alias("salts")), "substring-hot")
        rows = rows.where("at >= 0")
        dealt = rows.select("key", "doc", "at", F.lit(False).alias("hot"))
        if not hot.isEmpty():  # hot_share * buckets keys at most
            salted = F.xxhash64("key", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int")).alias("key")
            often = rows.join(F.broadcast(hot), "key").select(salted, "doc", "at", F.lit(True).alias("hot"))
            dealt = dealt.join(F.broadcast(hot), "key", "left_anti").unionByName(often)
        return self._write_run(dealt, hot, 0, self.manifest["next"])

    def _candidates(self, run: dict) -> tuple[DataFrame, DataFrame | None]:
        """(doc, places) of the batch and of history: grams that several documents have. All joins are by key between
        tables that are dealt and sorted by it."""
        new, by_key = self._run(run), W.partitionBy("key")
        marked = new.withColumns({"lo": F.min("doc").over(by_key), "hi": F.max("doc").over(by_key)})
        found = F.col("hot") | (F.col("lo") < F.col("hi"))
        keys, hot = new.where(~F.col("hot")).select("key").distinct(), self._hot(run).select("key")
        old, also = [], []
        for i, r in enumerate(self.runs):
            known = self._run(r).where(~F.col("hot")).select("key").distinct().withColumn(f"in_{i}", F.lit(True))
            marked = marked.join(known, "key", "left")
            found = found | F.col(f"in_{i}").isNotNull()
            old.append(self._run(r).join(keys, "key", "left_semi").select("doc", "at"))
            if r["hot"]:  # frequent in history: the batch's rows under the plain key are candidates
                also.append(new.join(F.broadcast(self._hot(r).select("key")), "key", "left_semi").select("doc", "at"))
            if r["hot"] or run["hot"]:
                asked = self._hot(r).join(F.broadcast(hot), "key", "left_semi").unionByName(F.broadcast(self._hot(r)).join(keys, "key", "left_semi").select("key", "salts")) if r["hot"] else None
                more = hot
                if asked is not None:
                    more = more.unionByName(asked.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda k: F.xxhash64("key", k))).alias("key")))
                old.append(self._run(r).join(F.broadcast(more.distinct()), "key", "left_semi").select("doc", "at"))
        places = lambda rows: rows.groupBy("doc").agg(F.collect_set("at").alias("places"))
        return places(reduce(DataFrame.unionByName, also, marked.where(found).select("doc", "at"))), places(reduce(DataFrame.unionByName, old)) if old else None

    def insert(self, batch: DataFrame) -> DataFrame:
        """Dedup the batch against itself and all earlier batches, and index it: doc_id, n_words, n_removed, kept_sha256.

        A result row for each row of the batch. Null texts have no words. Null ids are one document after all
        others. Rows repeating an id each have their own result; they are one document, so none is a repeat of
        another. Other columns are ignored. An empty batch leaves the index as it is.
        """
        spark, window, gram = self.spark, self.window, self.gram
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        texts = batch.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text.alias("text"))
        again = not texts.groupBy("doc").count().where("count > 1").isEmpty()  # ids of several rows, which their texts tell apart
        texts = texts.select("doc", (F.xxhash64("text") if again else F.lit(0).cast("long")).alias("tag"), "text")
        number = self.manifest["next"]
        stored = f"texts-{number:06d}"
        self._write(texts.mapInArrow(_compress, TEXTS), stored, "doc")
        own = self._read(stored, TEXTS, "doc")
        if own.isEmpty():
            self._forget(stored)
            return spark.createDataFrame([], RESULT)
        run = self._new_run(texts)
        fresh, old = self._candidates(run)

        def windows(of: DataFrame, places: DataFrame, kind: int) -> DataFrame:
            return of.join(places, "doc").select("doc", "tag", "z", "places").mapInArrow(partial(_window_rows, window=window, gram=gram, kind=kind), WINDOWS)

        rows = windows(own, staged(fresh, "substring-places", ordered=True), FRESH)
        if old is not None:
            old = staged(old, "substring-places", ordered=True)
            for name in self.manifest["texts"]:
                rows = rows.unionByName(windows(self._read(name, TEXTS, "doc"), old, OLD))
        met = rows.repartition(partitions(spark), "h").sortWithinPartitions("h")
        covered = staged(met.mapInArrow(_repeats, "doc long, tag long, at int").groupBy("doc").agg(F.collect_set(F.struct("tag", "at")).alias("covered")), "substring-covered")
        out = own.join(covered, "doc", "left").select("doc", "tag", "z", "covered").mapInArrow(partial(_remove, window=window), "doc long, n_words long, n_removed long, kept_sha256 string")
        out = staged(out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256"), "substring-kept")
        self._publish(next=number + 1, runs=[*self.runs, run], texts=[*self.manifest["texts"], stored])
        level = 0
        while sum(r["level"] == level for r in self.runs) >= self.fanout:
            self.compact(level)
            level += 1
        return out


def substring_dedup(docs: DataFrame, *, batches: int = 2, **options) -> DataFrame:
    """All documents, inserted in `batches` batches by ranges of ids of about equal numbers of rows, smallest ids first
    (null ids last), into an index of its own; so each batch meets the documents with smaller ids in its history."""
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 10_000).alias("at")).first()["at"]
    cuts, doc = sorted(set(cuts or [])), F.col("doc_id").cast("long")
    index, out = SubstringIndex(docs.sparkSession, **options), []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = docs.where(doc > lo) if hi is not None and lo is not None else docs.where((doc > lo) | doc.isNull()) if lo is not None else docs
        out.append(index.insert(part if hi is None else part.where(doc <= hi)))
    index.drop()
    return reduce(DataFrame.unionByName, out)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
with d as (select cast(doc_id as bigint) as doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
g as (select doc_id, i, min(doc_id) over (partition by list_slice(w, i, i + 12)) as low from s),
c as (select distinct doc_id, unnest(range(i, i + 13)) as pos from g where low < doc_id),
p as (select d.doc_id, d.w, list(c.pos) as gone from d left join c using (doc_id) group by d.doc_id, d.w),
k as (select doc_id, len(w) as n_words, case when gone[1] is null then w else list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i))), lambda i: w[i]) end as kept from p)
select doc_id, cast(n_words as bigint) as n_words, cast(n_words - len(kept) as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""
