import pytest
from pyspark.sql import functions as F

from quern.functions import posting as post
from quern.functions import strings
from quern.operators import analysis as an
from quern.operators import hits, segments, stats


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def terms(df):
    return [r["term"] for r in df.orderBy("doc_id", "ord").collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_default_analyzer(spark):
    df = docs(spark, "Error: Timeout connecting to the Database!", "error the error", "", None)
    assert terms(an.DEFAULT.terms(df)) == ["error", "timeout", "connecting", "database", "error"]
    assert [r["length"] for r in an.count_tokens(df).orderBy("doc_id").collect()] == [4, 1, 0, 0]
    assert [r["has_term"] for r in an.has_term(df, " TIMEOUT").orderBy("doc_id").collect()] == [True, False, False, False]
    assert len(an.STOPWORDS) == 99


def test_offsets_are_bytes(spark):
    rows = an.SimpleTokenizer().rows(docs(spark, "é: timeout_1 你好!"), True).orderBy("ord").collect()
    assert [(r["term"], r["start"], r["end"]) for r in rows] == [("é", 0, 2), ("timeout_1", 4, 13), ("你好", 14, 20)]


def test_tokenizers(spark):
    df = docs(spark, "ab-c1 x y")
    assert terms(an.WhitespaceTokenizer().rows(df)) == ["ab-c1", "x", "y"]
    assert terms(an.SimpleTokenizer(digits=False).rows(df)) == ["ab", "c", "x", "y"]
    assert terms(an.NGramTokenizer(2, 3).rows(docs(spark, "abc d"))) == ["ab", "bc", "abc"]
    assert terms(an.NGramTokenizer(0, -1).rows(docs(spark, "ab"))) == ["a", "b"]
    assert an.SimpleTokenizer(False, False, False).rows(df).count() == 0


def test_filters_and_gaps(spark):
    df = docs(spark, "Foo bar bar ×a foo_x")
    keep = lambda *f: terms(an.Analyzer(filters=f).terms(df))
    assert keep(an.DedupAdjacent()) == ["Foo", "bar", "a", "foo_x"]
    assert keep(an.MaxLength(3), an.MinLength(2)) == ["Foo", "bar", "bar"]
    assert keep(an.MaxLength(0), an.Stopwords(frozenset()), an.Prefix(""), None) == ["Foo", "bar", "bar", "a", "foo_x"]
    assert keep(an.Lowercase(), an.Prefix("foo")) == ["foo", "foo_x"]
    white = an.Analyzer(an.WhitespaceTokenizer(), (an.AsciiFold(),))
    rows = white.analyze(docs(spark, "à !! é")).orderBy("position").collect()
    assert [(r["position"], r["term"]) for r in rows] == [(0, "a"), (2, "e")]


def test_pipelines(spark):
    df = docs(spark, "The Foo-Bar the")
    assert terms(an.Pipeline().terms(df)) == ["foo", "bar"]
    assert terms(an.Pipeline((None,)).terms(df)) == []
    assert terms(an.Pipeline((an.IDENTITY, None, an.DEFAULT)).terms(df)) == ["foo", "bar"]


def test_strings(spark):
    assert one(spark, strings.normalize(F.lit("\t AbC "))) == "abc"
    assert one(spark, strings.normalize(F.lit("İΣΑΣ"))) == "iσασ"
    assert one(spark, strings.camel_split(F.lit("HTTPServerErrorCode"))) == ["HTTP", "Server", "Error", "Code"]
    assert one(spark, strings.camel_split(F.lit(""))) == []
    assert one(spark, strings.split_ident(F.lit(" foo_bar-baz é1 "))) == ["foo_bar", "baz", "1"]
    assert one(spark, strings.normalize_all(F.array(F.lit(" A"), F.lit("  ")))) == ["a"]
    assert one(spark, strings.fold_ascii(F.lit("Àçñöü-ß!_1"))) == "Acnouß_1"
    assert one(spark, strings.is_ident(F.lit("_"))) and not one(spark, strings.is_ident(F.lit("é")))
    assert an.stopword_list(" The ", "") | an.merge_stopwords(frozenset("x")) == {"the", "x"}


def ids(*values):
    return F.array(*[F.lit(v).cast("long") for v in values])


def test_posting_lists(spark):
    a, b = ids(1, 3, 5, 7), ids(3, 4, 7, 9)
    for got, want in [
        (post.intersect(a, b), [3, 7]), (post.union(a, b), [1, 3, 4, 5, 7, 9]), (post.difference(a, b), [1, 5]), (post.new(ids(5, 5, 1, 3, 3)), [1, 3, 5]),
        (post.within(a, 3, 5), [3, 5]), (post.deltas(a), [1, 2, 2, 2]), (post.from_deltas(post.deltas(a)), [1, 3, 5, 7]), (post.remove(a, F.lit(3).cast("long")), [1, 5, 7]),
        (post.union_many(a, b, ids(2)), [1, 2, 3, 4, 5, 7, 9]), (post.intersect_many(a, b, ids(7)), [7]), (post.keep(a, lambda x: x > 4), [5, 7]),
        (post.seek(a, 4), 5), (post.seek(a, 9), None), (post.remaining(a, 4), 2), (post.overlap(a, b), 2), (post.encoded_size(a), 20), (post.encoded_size(F.array()), 1), (post.equal(a, a), True),
    ]:
        assert one(spark, got) == want
    big = ids(1, 2, 10, 100, 1000, 100000)
    assert one(spark, post.decode(post.encode(big))) == [1, 2, 10, 100, 1000, 100000] == one(spark, post.decode_raw(post.encode_raw(big)))
    assert post.encode_ids([]) == b"\0" and post.decode_ids(b"") == [] and post.decode_ids(post.encode_ids([300]) + b"x") == [300]
    with pytest.raises(post.CorruptPosting):
        post.decode_ids(b"\x02\x01\x80")
    cursor = post.Cursor(spark.createDataFrame([(5,), (1,), (9,)], "doc_id long"))
    assert (cursor.peek(), cursor.next(), cursor.seek(6), cursor.next(), cursor.next()) == (1, 1, 9, 9, None)
    cursor.reset()
    assert cursor.next() == 1


def test_statistics(spark):
    tf = spark.createDataFrame([(1, "error", 2), (1, "timeout", 1), (2, "error", 1), (2, "gone", 0)], "doc_id long, term string, tf long")
    lengths = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, length long")
    assert {r["term"]: (r["count"], r["df"]) for r in stats.term_stats(tf).collect()} == {"error": (3, 2), "timeout": (1, 1)}
    assert stats.top_terms(tf, 0).count() == 0 and stats.average_length(lengths).first()[0] == 2.0
    got = one(spark, stats.bm25(F.lit(2), F.lit(2), F.lit(2), F.lit(3), F.lit(2.0)))
    assert got == pytest.approx(2 * 2.2 / (2 + 1.2 * 1.375))
    assert one(spark, stats.bm25(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), 1.0, 1.0)) == 0.0
    assert one(spark, stats.idf(F.lit(-1), F.lit(-5))) == 1.0
    assert {r["doc_id"] for r in stats.put(lengths, lengths.where("doc_id = 2")).collect()} == {1, 2}
    empty = stats.snapshot(tf.where("false"), lengths.where("false")).first()
    assert tuple(empty) == (0, 0, 0.0, [])


def test_hits(spark):
    scores = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 2.0), (2, 4.0)], "doc_id long, score double")
    top = [tuple(r) for r in hits.dedup_hits(scores).collect()]
    assert top == [(2, 5.0), (3, 2.0), (1, 1.0)]
    assert [r["doc_id"] for r in hits.sort_by_doc_id(scores).collect()] == [1, 2, 2, 3]
    none = scores.where("false").select("doc_id")
    assert hits.filter_live(scores, none).count() == 4 and hits.filter_live(scores, scores.where("doc_id = 2")).count() == 2
    assert hits.collect(scores.select("doc_id").distinct(), None, 2).collect()[0]["score"] == 1.0
    boost = hits.idf_boost_scorer(spark.createDataFrame([(1, 2)], "doc_id long, tf long"), 3.0)
    assert [tuple(r) for r in hits.collect(spark.range(1, 3).withColumnRenamed("id", "doc_id"), boost).collect()] == [(1, 7.0), (2, 1.0)]


def test_segments(spark):
    live = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 2)], "segment_id long, doc_id long")
    postings = spark.createDataFrame([(1, 1, "a"), (1, 1, "x"), (1, 2, "b"), (2, 3, "a"), (2, 3, "y"), (2, 2, "b"), (2, 9, "z")], "segment_id long, doc_id long, term string")
    dead = live.where("false")
    built = segments.build(live, postings)
    assert built.where("term = 'z'").count() == 0
    out = segments.merge(live, built, dead, 3)
    segments.verify_merge(live, built, dead, *out)
    assert out[0].count() == 3 and out[1].where("term = 'a'").count() == 2 and out[1].where("term = 'b'").count() == 1
    with pytest.raises(segments.SegmentError):
        segments.verify_merge(live, built, dead, out[0].limit(1), out[1])
    gone = spark.createDataFrame([(1, 1)], "segment_id long, doc_id long")
    assert segments.alive(built, gone).where("term = 'a'").count() == 1
    assert segments.dir_name(255) == "seg-00000000000000ff"
    policy, metas = segments.Policy(2, 10_000, 2), [segments.Meta(i, n, 1, 9, 5) for i, n in ((1, 50), (2, 10), (3, 10))]
    assert policy.plan(metas, 7) == ([2, 3], 7) and [m.id for m in segments.exclude_ids(metas, [1])] == [2, 3]
    assert not segments.Policy().needs_compaction(metas[:2]) and segments.Policy().needs_compaction(metas)
    assert tuple(segments.dry_run(live, built).first()) == (3, 1, 3, 4)


def test_merge_problems_are_counted_in_one_pass(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "segment_id long, doc_id long, term string")
    ids = lambda *x: spark.createDataFrame(list(x), "segment_id long, doc_id long")
    live, postings, dead = ids((1, 1), (1, 2), (2, 2), (2, 3)), rows((1, 1, "a"), (1, 2, "b"), (2, 2, "b"), (2, 3, "c")), ids((1, 1), (2, 2))
    out = rows((9, 2, "b"), (9, 2, "b"), (8, 2, "b"), (8, 1, "a"), (8, 1, "a"), (9, 3, "x"))
    problems = segments.merge_problems(live, postings, dead, ids((9, 2), (9, 4)), out)
    assert sorted((r[0], r[1], r[2] or "") for r in problems.collect()) == [
        ("missing document", 3, ""), ("missing posting", 3, "c"), ("repeated posting", 1, "a"), ("repeated posting", 2, "b"),
        ("unexpected document", 4, ""), ("unexpected posting", 1, "a"), ("unexpected posting", 1, "a"), ("unexpected posting", 3, "x"),
    ]
    plan = segments.merge_problems(live, postings, dead, *segments.merge(live, postings, dead, 9))._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("Generate explode") :].count("Exchange hashpartitioning") == 4  # postings and tombstones, for the merge and for the check


def test_offsets_shuffle_texts_and_no_runs(spark):
    docs = spark.createDataFrame([(1, "Äb, c"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    tokens = an.SimpleTokenizer().rows(docs, True)
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, tokens.collect())) == [(1, 0, "Äb", 0, 3), (1, 1, "c", 5, 6), (4, 0, "x", 0, 1)]
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_drop_does_not_sort_the_table(spark):
    table = spark.range(50_000).selectExpr("id % 500 as doc_id", "cast(id as string) as term", "1L as tf")
    left = stats.drop(table, spark.createDataFrame([(1,), (1,), (7,)], "doc_id long"))
    assert "Sort" not in left._jdf.queryExecution().executedPlan().toString()
    assert left.count() == 50_000 - 200 and left.where("doc_id in (1, 7)").isEmpty()
