import random

import pytest
from pyspark.sql import functions as F

from quern.index import EmptyQuery, IndexClosed, InvalidDocument, SearchIndex
from quern.operators.segments import Policy
from quern.plans.query import And, Not, Or, Term
from quern.sources import changes as log
from quern.streaming.ingest import ingest

LOGS = [
    (1, "error timeout connecting to database server"),
    (2, "info user login success from gateway"),
    (3, "error disk full on volume data"),
    (4, "warn timeout waiting for lock"),
    (5, "debug cache hit ratio high"),
    (6, "error timeout disk io wait"),
    (7, "info scheduled backup completed"),
    (8, "fatal database connection refused"),
]
QUERIES = [
    (Term("error"), [1, 3, 6]),
    (Term("timeout"), [1, 4, 6]),
    (And(Term("error"), Term("timeout")), [1, 6]),
    (Or(Term("database"), Term("cache")), [1, 5, 8]),
    (And(Term("error"), Not(Term("disk"))), [1]),
    (Or(Term("info"), And(Term("error"), Term("timeout"))), [1, 2, 6, 7]),
    (Not(Term("error")), [2, 4, 5, 7, 8]),
]


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("logs")))
    index.add_all(spark.createDataFrame(LOGS, "doc_id long, text string"))
    index.flush()
    return index


@pytest.mark.parametrize("q, want", QUERIES)
def test_index_and_brute_force(logs, q, want):
    assert ids(logs.search(q)) == want == ids(logs.brute_force(q))


def test_random_queries(logs):
    rng = random.Random(3)
    words = "error timeout disk info database the nothing".split()

    def tree(depth):
        kind = rng.choice(["t", "a", "o", "n"]) if depth else "t"
        if kind == "t":
            return Term(rng.choice(words))
        if kind == "n":
            return Not(tree(depth - 1))
        return (And if kind == "a" else Or)(*[tree(depth - 1) for _ in range(rng.randint(1, 3))])

    for _ in range(6):
        q = tree(3)
        assert ids(logs.search(q)) == ids(logs.brute_force(q)), str(q)


def test_scores(spark, logs):
    score = lambda q, **o: [tuple(r) for r in logs.search(q, **o).collect()]
    assert score(And(Term("error"), Term("error"))) == [(1, 2.0), (3, 2.0), (6, 2.0)]
    assert score(Or(Term("error"), Not(Term("timeout"))))[0] == (1, 2.0)
    assert {s for _, s in score(Not(Term("error")))} == {0.0}
    assert [d for d, _ in score(Term("error"), limit=2)] == [1, 3]
    assert score(Term("error"), scorer="bm25")[0][0] == 1  # equal lengths, so ties
    assert [r[0] for r in logs.search_doc_ids("error and timeout").collect()] == [1, 6]


def test_ids_are_not_cut_at_max_hits(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), max_hits=2)
    index.add_all(spark.createDataFrame(LOGS, "doc_id long, text string"))
    assert ids(index.search("error")) == [1, 3]
    assert [r[0] for r in index.search_doc_ids("error or timeout").collect()] == [1, 3, 4, 6]
    assert [r[0] for r in index.search_doc_ids("error", limit=2).collect()] == [1, 3]


def test_empty_closed_and_bad_ids(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path))
    for bad in (Term(""), And(Term(""), Term(" "))):
        with pytest.raises(EmptyQuery):
            index.search(bad)
    with pytest.raises(InvalidDocument):
        index.add(0, "x")
    with pytest.raises(InvalidDocument):
        index.delete(0)
    index.close()
    index.close()
    with pytest.raises(EmptyQuery):
        index.search(Term(""))
    with pytest.raises(IndexClosed):
        index.search(Term("x"))


def test_visibility_delete_reopen(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path))
    index.add(10, "alpha beta gamma")
    index.add(11, "")
    assert ids(index.search(Term("alpha"))) == [10]
    assert ids(index.search(Not(Term("alpha")))) == [11]
    assert index.mem_doc_count() == 2
    reopened = SearchIndex(spark, str(tmp_path))  # the log alone
    assert ids(reopened.search(Term("alpha"))) == [10]
    index.flush()
    assert index.mem_doc_count() == 0 and index.segment_count() == 1
    index.add(10, "delta")
    index.flush()
    index.delete(11)
    index.delete(99)
    index.flush()
    index.close()
    index = SearchIndex(spark, str(tmp_path))
    assert ids(index.search(Term("alpha"))) == [] and ids(index.search(Not(Term("alpha")))) == [10]
    assert index.search(Term("delta")).collect()[0]["score"] == 1.0
    assert index.doc_text(10) == "delta" and index.doc_text(11) is None
    assert index.info().startswith(f"root={tmp_path} segs=")


def test_merge_keeps_results(spark, tmp_path):
    rows = ["red apple fruit", "green apple tree", "red berry fruit", "blue berry juice", "green tea leaf", "red tea pot"]
    index = SearchIndex(spark, str(tmp_path), flush_threshold=2, merge_policy=Policy(2, 10_000, 2))
    for i, text in enumerate(rows, 1):
        index.add(i, text)
    assert index.segment_count() < 3
    assert ids(index.search(And(Term("red"), Term("fruit")))) == [1, 3] == ids(index.brute_force("red and fruit"))
    meta = index.segment_metas()
    assert sum(m.doc_count for m in meta) == 6
    snapshot = index.stats_snapshot().first()
    assert snapshot["num_docs"] == 6 and snapshot["avg_doc_len"] == 3.0 and snapshot["top_terms"][0]["term"] == "red"


def test_no_stats_scores_one(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), stats=False, wal=False, max_hits=-1)
    index.add(1, "a1 a1x a1")
    assert [tuple(r) for r in index.search(Term("a1")).collect()] == [(1, 1.0)]
    assert index.options.max_hits == 10_000


def test_streaming_ingest(spark, tmp_path):
    rows = [(1, log.ADD, 1, "hello world"), (2, log.ADD, 2, "hello there"), (3, log.DELETE, 1, ""), (4, log.ADD, 2, "bye now2")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, log.SCHEMA).coalesce(1).write.parquet(source)
    index = SearchIndex(spark, str(tmp_path / "index"))
    stream = spark.readStream.schema(log.SCHEMA).parquet(source)
    ingest(stream, index, str(tmp_path / "checkpoint")).awaitTermination()
    assert ids(index.search(Term("hello"))) == [] and ids(index.search(Term("now2"))) == [2]
    again = SearchIndex(spark, str(tmp_path / "index"))
    ingest(stream, again, str(tmp_path / "checkpoint")).awaitTermination()
    assert ids(again.live_docs()) == [2] and again.manifest["last_batch"] == 0


def test_log_frames():
    data = log.record(log.ADD, 1, "hello world") + log.record(log.DELETE, 1)
    assert [r["op"] for r in log.replay(data)] == [1, 2]
    assert log.replay(data + b"\0\0\0") == log.replay(data) and log.replay(b"") == []
    for bad in (data[:-1], data[:10] + b"?" + data[11:], b"\xff\xff\xff\xff" + data):
        with pytest.raises(log.CorruptLog):
            log.replay(bad)
    one = len(log.record(log.ADD, 1, "hello world"))
    with pytest.raises(log.CorruptLog) as e:
        log.replay(data[:one] + data[one:-1] + b"?")
    assert len(e.value.records) == 1


def test_invalid_batch_is_refused(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path))
    with pytest.raises(Exception, match="positive"):
        index.add_all(spark.createDataFrame([(0, "x")], "doc_id long, text string"))


def test_changes_fold(spark):
    rows = [(1, 1, 5, "a"), (2, 2, 5, ""), (3, 1, 6, None), (4, 9, 7, "z")]
    df = spark.createDataFrame(rows, log.SCHEMA)
    assert [tuple(r) for r in log.live(df).collect()] == [(6, "")]
    assert ids(log.pending_deletes(df)) == [5]
    assert sorted(r[0] for r in df.select(log.op_name(F.col("op"))).collect()) == ["add", "add", "delete", "op(9)"]


def test_a_segment_is_written_without_a_shuffle_of_texts_or_postings(spark, tmp_path):
    """A batch that changes no document twice: what is shuffled does not grow with its texts' lengths."""
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(stages.apply(i).shuffleWriteBytes() for stages in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)] for i in range(stages.size()))
    index = SearchIndex(spark, str(tmp_path), merge_policy=Policy(2, 10_000, 2))
    texts = spark.range(1, 401).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("w"), (F.hash(i, "id") % 500).cast("string")))).alias("text"))
    before = shuffled()
    index.add_all(texts)
    index.flush()
    index.add_all(texts.where("doc_id % 4 = 0").select("doc_id", F.lit("new new").alias("text")))
    index.flush()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffled() - before < 200_000  # the postings alone are 500 KB and more
    assert index.segment_count() == 1 and index.live_docs().count() == 400
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.live_tf()) == rows(index.all_tf()) and (4, "new", 1) in rows(index.all_tf())


def test_an_index_from_before_counts_were_stored(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), merge_policy=Policy(2, 10_000, 2))
    index.add_all(spark.createDataFrame(LOGS + [(9, "")], "doc_id long, text string"))
    index.flush()
    rows = lambda df: sorted(map(tuple, df.collect()))
    want, at = rows(index.all_tf()), index.store.full("segments/seg-0000000000000001/docs")
    old = spark.createDataFrame(spark.read.parquet(at).drop("counts").collect(), "segment_id long, doc_id long, text string, length long")
    old.write.mode("overwrite").parquet(at)
    index.store.save_manifest({k: v for k, v in index.manifest.items() if k != "format"})
    again = SearchIndex(spark, str(tmp_path), merge_policy=Policy(2, 10_000, 2))
    assert rows(again.all_tf()) == want == rows(again.live_tf())
    again.add(10, "error again")
    again.flush()
    assert again.segment_count() == 1 and rows(again.all_tf()) == sorted([*want, (10, "error", 1)]) == rows(again.live_tf())
    assert again.live_docs().count() == 10


def test_brute_force_analyses_a_text_once(spark, tmp_path):
    analysed = spark.sparkContext.accumulator(0)

    class Counting:
        @F.udf("array<string>")
        def split(text):
            analysed.add(1)
            return text.split()

        def list(self, text):
            return Counting.split(text)

    index = SearchIndex(spark, str(tmp_path / "once"), analyzer=Counting())
    index.add_all(spark.createDataFrame(LOGS, "doc_id long, text string"))
    index.flush()
    analysed.value = 0
    assert [r["doc_id"] for r in index.brute_force("error and not disk").collect()] == [1]
    assert analysed.value == len(LOGS)  # not once more to find the ranges of the sort
    plain = SearchIndex(spark, str(tmp_path / "plain"))
    plain.add_all(spark.createDataFrame(LOGS, "doc_id long, text string"))
    plain.flush()
    rows = plain.brute_force("error and not disk and not io")
    assert [r["doc_id"] for r in rows.collect()] == [1]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # however many terms the query has
