"""What an index has after crashes and odd batches, and its views of segments and moments."""

import pytest
from pyspark.sql import functions as F

from quern.functions import posting as post
from quern.index import SearchIndex
from quern.operators import segments as seg
from quern.plans.query import Not, Term
from quern.sources import changes as log
from quern.streaming.ingest import ingest

DOCS = "doc_id long, text string"


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_empty_batch_and_reopen(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path))
    index.add_all(spark.createDataFrame([], DOCS))
    index.add_all(spark.createDataFrame([(1, "alpha")], DOCS))
    index.delete_all(spark.createDataFrame([], "doc_id long"))
    again = SearchIndex(spark, str(tmp_path))
    assert ids(again.search(Term("alpha"))) == [1] and again.mem_doc_count() == 1
    again.flush()
    assert ids(SearchIndex(spark, str(tmp_path)).search(Term("alpha"))) == [1]


def test_unfinished_batch_is_ignored_and_altered_one_refused(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path))
    index.add_all(spark.createDataFrame([(1, "alpha"), (2, "beta")], DOCS))
    rows = [(7, log.ADD, 3, "torn")]
    spark.createDataFrame(rows, log.SCHEMA).write.parquet(f"{tmp_path}/log/{index._next_log:012d}")  # cut off before its mark
    again = SearchIndex(spark, str(tmp_path))
    assert ids(again.live_docs()) == [1, 2]
    again.add_all(spark.createDataFrame([(4, "gamma")], DOCS))
    assert ids(SearchIndex(spark, str(tmp_path)).live_docs()) == [1, 2, 4]
    spark.createDataFrame(rows, log.SCHEMA).write.mode("append").parquet(f"{tmp_path}/log/{again._batches[0]}")
    with pytest.raises(log.CorruptLog):
        SearchIndex(spark, str(tmp_path))


def test_simultaneous_changes(spark, tmp_path):
    rows = [(log.ADD, 1, "b"), (log.ADD, 1, "c"), (log.ADD, 2, "x"), (log.DELETE, 2, ""), (log.ADD, 3, None)]
    index = SearchIndex(spark, str(tmp_path))
    before = index._seq
    index.apply(spark.createDataFrame(rows, "op int, doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["text"] for r in index.live_docs().collect()} == {1: "c", 3: ""} and index._seq == before + 1
    index.add(1, "later")
    assert index.doc_text(1) == "later"


def test_merge_rewrites_tombstones(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), merge_policy=seg.Policy(3, 10_000, 2))
    for lo in (1, 40, 80):
        index.add_all(spark.range(lo, lo + 35).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), "id").alias("text")))
        if lo < 80:
            index.flush()
    index.delete_all(spark.createDataFrame([(1,), (2,), (41,)], "doc_id long"))
    index.flush()  # merges the two smallest of three segments
    metas = index.segment_metas()
    assert index.segment_count() == 2 and sum(m.doc_count for m in metas) == 102
    left = index.tombstones().collect()
    assert {r["segment_id"] for r in left} <= {m.id for m in metas}
    assert len(index.store.names("tombstones")) == len(index.manifest["tombstones"])
    again = SearchIndex(spark, str(tmp_path))
    assert again.live_docs().count() == 102 == again.search(Term("word")).count()
    assert not again.has_doc(41) and again.has_doc(42)


def test_stream_batch_is_applied_once(spark, tmp_path):
    rows = [(1, log.ADD, 1, "hello world"), (2, log.ADD, 2, "hello there"), (3, log.DELETE, 1, "")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, log.SCHEMA).coalesce(1).write.parquet(source)
    crashed = SearchIndex(spark, str(tmp_path / "index"))
    crashed.apply(spark.createDataFrame(rows, log.SCHEMA), 0)  # batch 0 reached the log, and then the driver died
    index = SearchIndex(spark, str(tmp_path / "index"))
    assert index.last_batch == 0
    index.add(9, "between")
    stream = spark.readStream.schema(log.SCHEMA).parquet(source)
    ingest(stream, index, str(tmp_path / "checkpoint")).awaitTermination()
    assert ids(index.live_docs()) == [2, 9] and index.segment_count() == 1 and index.mem_doc_count() == 0


def test_views(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), merge_policy=seg.Policy(8, 10_000, 9))
    index.add_all(spark.createDataFrame([(1, "Alpha beta"), (2, "beta"), (3, "gamma")], DOCS))
    index.flush()
    index.delete(2)
    now = index.snapshot()
    index.add(4, "beta")
    assert ids(now.posting("beta")) == [1] and now.posting(" Beta").count() == 0 and now.doc_count() == 2
    assert now.is_live(3) and not now.is_live(2) and not now.is_live(4)
    assert ids(index.posting(" Beta ")) == [1, 4] and index.has_doc(4) and not index.has_doc(2)
    one = index.segment(1)
    assert ids(one.posting("beta")) == [1, 2] and sorted(r[0] for r in one.terms().collect()) == ["alpha", "beta", "gamma"]
    assert one.is_live(2) and not one.is_live(4) and one.all_postings().count() == 4 and ids(one.live_docs()) == [1, 2, 3]
    index.flush()
    assert not index.segment(1).is_live(2) and index.segments().ids() == [1, 2]
    with pytest.raises(KeyError):
        index.segment(7)
    assert index.segments().total_docs().first()[0] == 3 and index.log_path == f"{tmp_path}/log"


def test_set_and_builder(spark):
    live = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 4)], "segment_id long, doc_id long")
    dead = spark.createDataFrame([(1, 1)], "segment_id long, doc_id long")
    some = seg.SegmentSet(live, dead, [seg.Meta(2, 1, 2, 2, 1), None, seg.Meta(1, 2, 1, 2, 3)])
    some.add(None)
    assert len(some) == 2 and some.ids() == [1, 2] and some.find(2).doc_count == 1 and some.find(9) is None
    assert some.total_docs().first()[0] == 1 and some.remove(1) and not some.remove(1) and [m.id for m in some.all()] == [2]
    builder = seg.Builder()
    builder.add_doc(1, ["a", "", "b"])
    builder.add_doc(1, ["a", "c"])
    builder.add_doc(2, ["a"])
    builder.add_doc(3, [])
    builder.delete_doc(2)
    builder.delete_doc(9)
    docs, postings = builder.build(spark, 5)
    assert builder.doc_count() == 2 and ids(docs) == [1, 3]
    assert sorted(map(tuple, postings.collect())) == [(5, 1, "a"), (5, 1, "b"), (5, 1, "c")]


def test_posting_ends_codec_and_cursors(spark):
    a = F.array(*[F.lit(x).cast("long") for x in (3, 5, 9)])
    none = F.array().cast("array<bigint>")
    row = spark.range(1).select(post.lowest(a), post.highest(a), post.lowest(none), post.highest(none), post.removed(a, F.lit(5)), post.removed(a, F.lit(6)), post.from_deltas(none)).first()
    assert tuple(row) == (3, 9, None, None, True, False, [])
    for values in ([], [0], [1, 2, 300, 1 << 40, (1 << 62) + 5], list(range(0, 5000, 7))):
        data = post.encode_ids(values)
        assert post.decode_ids(data) == values == post.decode_ids(data + b"\x05")
        for cut in range(1, min(len(data), 12)):
            with pytest.raises(post.CorruptPosting):
                post.decode_ids(data[:-cut])
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda x: x.cast("long")).alias("a"))
    assert long.select(post.from_deltas(post.deltas(F.col("a"))) == F.col("a")).first()[0]
    found = []
    cursors = [post.Cursor(spark.createDataFrame([(x,) for x in xs], "doc_id long")) for xs in ((1, 4, 6, 9, 12), (2, 4, 9, 12, 13))]
    post.intersect_each(*cursors, lambda x: found.append(x) or len(found) < 2)
    assert found == [4, 9]


def test_term_is_trimmed_like_columns():
    assert Term("\x1fa").term == "\x1fa" and Term("\u2003A\x85").term == "a" and str(Not(Term("İ"))) == 'NOT("i")'


def test_framed_log_round_trip(spark, tmp_path):
    rows = [(1, log.ADD, 1, 'say "é"\n'), (2, log.DELETE, 1, ""), (3, log.ADD, 2, None)]
    changes = spark.createDataFrame(rows, log.SCHEMA)
    back = log.replayed(log.frames(changes)).select("seq", "op", "doc_id", "text").collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)
    path = tmp_path / "wal.log"
    path.write_bytes(log.record(log.ADD, 5, "x") + log.record(log.DELETE, 5))
    assert [(r["op"], r["doc_id"]) for r in log.read(spark, str(path)).collect()] == [(1, 5), (2, 5)]
