"""The engine's queries over the driver tables, each with the SQL that gives the same rows.

Ids start at 0 in the tables and the engine refuses 0, so the corpus is `documents` with ids larger by one.
Analysis reads the texts; searches, statistics, posting lists and segments read a `SearchIndex` that the
first of them builds in the shared folder and all later ones of the application open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import posting as post
from quern.functions import strings
from quern.index import SearchIndex
from quern.operators import analysis as an
from quern.operators import hits, stats
from quern.operators import segments as seg
from quern.plans import compile as plan
from quern.plans.query import And, Not, Or, Query, Term, cost, optimize, parse
from quern.sources import changes as log
from quern.sources.store import dealt, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STOP = ", ".join(f"'{w}'" for w in sorted(an.STOPWORDS))
WORDS = r"[\p{L}\p{Nd}_]+"
BLACK = r"[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


DOCS = "(select doc_id + 1 as doc_id, text from documents)"


def cte(source: str = f"select * from {DOCS}") -> str:
    return f"""
with src as ({source}),
tok as (select doc_id, lower(unnest(w)) term, generate_subscripts(w, 1) pos from (select doc_id, regexp_extract_all(text, '{WORDS}') w from src)),
kept as (select * from tok where term not in ({STOP})),
dd as (select *, lag(term) over (partition by doc_id order by pos) prev from kept),
terms as (select doc_id, term, pos, row_number() over (partition by doc_id order by pos) - 1 as position from dd where prev is null or prev <> term),
tf as (select doc_id, term, count(*) tf from terms group by all),
lens as (select src.doc_id, count(terms.term) as length from src left join terms using (doc_id) group by 1)
"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select((F.col("doc_id") + 1).alias("doc_id"), "text")


_ROOTS: dict[tuple[str, str, str], str] = {}


def _built(spark: SparkSession, d: str, kind: str, fill: Callable[[SearchIndex], None], **options) -> SearchIndex:
    """The index of this kind over the tables in d, opened; the first caller of an application fills it."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _ROOTS:
        root = scratch(spark, f"index-{kind}")
        with SearchIndex(spark, root, **options) as index:
            fill(index)
        _ROOTS[key] = root
    return SearchIndex(spark, _ROOTS[key], **options)


def index_of(spark: SparkSession, d: str) -> SearchIndex:
    """All of `documents` in one segment."""

    def fill(index: SearchIndex) -> None:
        index.add_all(corpus(spark, d))
        index.flush()

    return _built(spark, d, "corpus", fill)


def tf_of(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).live_tf()


def ids_of(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).live_docs().select("doc_id")


def lengths_of(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).live_docs().select("doc_id", "length")


def list_sql(column: str) -> str:
    """Numbers of an array as text, so that both sides hash alike."""
    return f"array_to_string({column}, ',')"


def as_text(c) -> F.Column:
    return F.array_join(c.cast("array<string>"), ",")


# Analysis

query("analyze_default_terms", cte() + "select doc_id, cast(position as bigint) as position, term from terms")(
    lambda s, d: an.DEFAULT.terms(corpus(s, d)).select("doc_id", F.col("ord").cast("long").alias("position"), "term")
)
query("analyze_unique_terms", cte() + "select doc_id, term from tf")(lambda s, d: an.term_lists(corpus(s, d), unique=True).select("doc_id", F.explode("terms").alias("term")))
query("analyze_term_freq", cte() + "select doc_id, term, tf from tf")(lambda s, d: an.term_freq(corpus(s, d)))
query("analyze_doc_length", cte() + "select doc_id, length from lens")(lambda s, d: an.count_tokens(corpus(s, d)))
query("analyze_has_term", cte() + "select src.doc_id, src.doc_id in (select doc_id from tf where term = 'er') as has_term from src")(lambda s, d: an.has_term(corpus(s, d), "  ER "))
query(
    "tokenize_simple_positions",
    f"""with r as (select doc_id, regexp_extract_all(text, '{WORDS}|[^\\p{{L}}\\p{{Nd}}_]+') w from {DOCS}),
    e as (select doc_id, unnest(w) term, generate_subscripts(w, 1) run from r),
    o as (select *, sum(octet_length(encode(term))) over (partition by doc_id order by run) as fin from e)
    select doc_id, cast(row_number() over (partition by doc_id order by run) - 1 as bigint) as position, term,
      cast(fin - octet_length(encode(term)) as bigint) as start_byte, cast(fin as bigint) as end_byte
    from o where regexp_full_match(term, '{WORDS}')""",
)(lambda s, d: an.SimpleTokenizer().rows(corpus(s, d), True).select("doc_id", F.col("ord").cast("long").alias("position"), "term", F.col("start").cast("long").alias("start_byte"), F.col("end").cast("long").alias("end_byte")))
query(
    "tokenize_whitespace",
    f"""select doc_id, cast(generate_subscripts(w, 1) - 1 as bigint) as position, unnest(w) as term
    from (select doc_id, regexp_extract_all(text, '{BLACK}') w from {DOCS})""",
)(lambda s, d: an.WhitespaceTokenizer().rows(corpus(s, d)).select("doc_id", F.col("ord").cast("long").alias("position"), "term"))
query(
    "tokenize_ngram",
    f"""with t as (select item_id, unnest(regexp_extract_all(text, '{WORDS}')) w from benchmark),
    n as (select item_id, w, unnest([2, 3]) n from t)
    select item_id as doc_id, substr(w, i, n) as term, count(*) as n from (select *, unnest(range(1, length(w) - n + 2)) as i from n where length(w) >= n) group by all""",
)(lambda s, d: an.NGramTokenizer(2, 3).rows(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).groupBy("doc_id", "term").agg(F.count("*").alias("n")))


def _filtered(*filters):
    """Counts of the terms that a chain of filters leaves."""
    analyzer = an.Analyzer(filters=(an.Lowercase(), *filters))
    return lambda s, d: an.term_freq(corpus(s, d), analyzer)


def _filter_sql(where: str, term: str = "term") -> str:
    return cte() + f"select doc_id, {term} as term, count(*) as tf from tok where {where} group by all"


query("filter_lowercase", _filter_sql("true"))(_filtered())
query("filter_min_length", _filter_sql("length(term) >= 4"))(_filtered(an.MinLength(4)))
query("filter_max_length", _filter_sql("length(term) <= 5"))(_filtered(an.MaxLength(5)))
query("filter_stopword", _filter_sql(f"term not in ({STOP})"))(_filtered(an.Stopwords()))
query("filter_prefix", _filter_sql("starts_with(term, 're')"))(_filtered(an.Prefix("re")))
query(
    "filter_dedup_adjacent",
    cte() + "select doc_id, term, count(*) as tf from (select *, lag(term) over (partition by doc_id order by pos) p from tok) where p is null or p <> term group by all",
)(_filtered(an.DedupAdjacent()))
FROM = "".join(strings.FOLDS.values())
TO = "".join(k * len(v) for k, v in strings.FOLDS.items())
query("filter_ascii_fold", _filter_sql("true", f"translate(term, '{FROM}', '{TO}')"))(_filtered(an.AsciiFold()))
query("pipeline_chain", _filter_sql(f"length(term) >= 3 and term not in ({STOP})"))(
    lambda s, d: an.term_freq(corpus(s, d), an.Pipeline((an.Analyzer(filters=(an.MinLength(3),)), an.Analyzer(filters=(an.Lowercase(), an.Stopwords())))))
)
query(
    "analyze_identity",
    f"""with t as (select doc_id, lower(unnest(regexp_extract_all(text, '{BLACK}'))) term from {DOCS})
    select doc_id, term, count(*) as tf from t group by all""",
)(lambda s, d: an.term_freq(corpus(s, d), an.IDENTITY))
query("normalize", "select p_partkey, lower(trim(p_name)) as term from part")(lambda s, d: table(s, d, "part").select("p_partkey", strings.normalize(F.concat(F.lit("\t "), "p_name", F.lit("\n"))).alias("term")))
query("split_ident", f"select page_id, {list_sql("regexp_extract_all(url, '[A-Za-z0-9_]+')")} as parts from pages")(lambda s, d: table(s, d, "pages").select("page_id", as_text(strings.split_ident(F.col("url"))).alias("parts")))
_SEP = "\x1f"
query(
    "camel_split",
    f"""with n as (select p_partkey, replace(p_name, ' ', '') || 'HTTPServerName' as s from part),
    a as (select p_partkey, regexp_replace(s, '([A-Z])([A-Z][^A-Z])', '\\1{_SEP}\\2', 'g') s from n),
    b as (select p_partkey, regexp_replace(s, '([^A-Z{_SEP}])([A-Z])', '\\1{_SEP}\\2', 'g') s from a)
    select p_partkey, array_to_string(string_split(s, '{_SEP}'), ',') as parts from b""",
)(lambda s, d: table(s, d, "part").select("p_partkey", as_text(strings.camel_split(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("HTTPServerName")))).alias("parts")))

# Search

_ER, _RE = "select doc_id from tf where term = 'er'", "select doc_id from tf where term = 're'"


def _search(q: Query | str):
    q = parse(q) if isinstance(q, str) else optimize(q)
    return lambda s, d: plan.matching(q, tf_of(s, d), ids_of(s, d))


query("search_term", cte() + _ER)(_search(Term("ER ")))
query("search_and", cte() + f"select doc_id from ({_ER}) where doc_id in ({_RE})")(_search(And(Term("er"), Term("re"))))
query("search_or", cte() + "select distinct doc_id from tf where term in ('er', 're')")(_search(Or(Term("er"), Term("re"))))
query("search_not", cte() + f"select doc_id from src where doc_id not in ({_ER})")(_search(Not(Term("er"))))
query("search_and_not", cte() + f"select doc_id from ({_ER}) where doc_id not in ({_RE})")(_search(And(Term("er"), Not(Term("re")))))
query("search_nested", cte() + f"select doc_id from src where doc_id in (select doc_id from tf where term = 'die') or (doc_id in ({_ER}) and not (doc_id in ({_RE}) or doc_id in (select doc_id from tf where term = 'de')))")(
    _search(Or(Term("die"), And(Term("er"), Not(Or(Term("re"), Term("de"))))))
)
query("search_parsed", cte() + f"select doc_id from src where doc_id in ({_ER}) and (doc_id in ({_RE}) or doc_id not in (select doc_id from tf where term = 'die'))")(_search("er AND (re or NOT die)"))


def _scored(q: Query, limit: int, scorer: str = "tf"):
    def run(s: SparkSession, d: str) -> DataFrame:
        docs, tf = ids_of(s, d), tf_of(s, d)
        ids = plan.matching(q, tf, docs)
        if scorer == "const":
            return hits.collect(ids, None, limit)
        return hits.collect(ids, hits.table_scorer(plan.weighted_tf(q, tf)), limit)

    return run


_RANK = "order by score desc, doc_id limit"
query("search_scored_topk", cte() + f"select doc_id, cast(sum(tf) as double) as score from tf where term in ('er', 're') group by 1 having count(*) = 2 {_RANK} 10")(_scored(And(Term("er"), Term("re")), 10))
query("search_score_multiplicity", cte() + f"select doc_id, cast(2 * tf as double) as score from tf where term = 'er' {_RANK} 10")(_scored(And(Term("er"), Term("er")), 10))
query(
    "search_score_not_leaf",
    cte() + f"select doc_id, cast(coalesce((select sum(tf) from tf where tf.doc_id = src.doc_id and term in ('er', 're')), 0) as double) as score from src where doc_id in ({_ER}) or doc_id not in ({_RE}) {_RANK} 50",
)(_scored(Or(Term("er"), Not(Term("re"))), 50))
query("search_const_score", cte() + f"select doc_id, 1.0::double as score from ({_ER}) order by doc_id limit 20")(_scored(Term("er"), 20, "const"))
query("search_doc_ids_limited", cte() + f"select doc_id from (select doc_id, tf as score from tf where term = 'er' {_RANK} 10)")(lambda s, d: hits.doc_ids(_scored(Term("er"), 10)(s, d)))


def _brute(q: Query):
    return lambda s, d: an.term_lists(corpus(s, d)).where(plan.predicate(q, F.col("terms"))).select("doc_id")


query("brute_force_and", cte() + f"select doc_id from ({_ER}) where doc_id in ({_RE})")(_brute(And(Term("er"), Term("re"))))


@query("brute_vs_index_diff", cte() + "select doc_id from src where false")
def brute_vs_index_diff(s: SparkSession, d: str) -> DataFrame:
    q = Or(Term("die"), And(Term("er"), Not(Term("re"))))
    a, b = _search(q)(s, d), _brute(q)(s, d)
    return a.join(b, "doc_id", "left_anti").unionByName(b.join(a, "doc_id", "left_anti"))


@query("cost_estimate", cte() + "select least((select count(*) from tf where term = 'er'), (select count(*) from tf where term in ('re', 'die')), (select count(*) from src) - (select count(*) from tf where term = 'de')) as cost")
def cost_estimate(s: SparkSession, d: str) -> DataFrame:
    q = And(Term("er"), Or(Term("re"), Term("die")), Not(Term("de")))
    wanted = tf_of(s, d).where(F.col("term").isin("er", "re", "die", "de"))
    df = {r["term"]: r["n"] for r in wanted.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return s.createDataFrame([(cost(q, df, ids_of(s, d).count()),)], "cost long")


# Posting lists


BLOCK = 4096  # ids of a posting list that stand in one row together


def _lists(s: SparkSession, d: str) -> DataFrame:
    """The lists of two terms, a row for each block of ids: block, a, b."""
    rows = tf_of(s, d).where(F.col("term").isin("er", "re")).select("term", "doc_id", F.floor(F.col("doc_id") / BLOCK).alias("block"))
    per_term = rows.groupBy("term", "block").agg(post.new(F.collect_list("doc_id")).alias("ids"))
    pick = lambda t: F.coalesce(F.max(F.when(F.col("term") == t, F.col("ids"))), F.array().cast("array<bigint>"))
    return per_term.groupBy("block").agg(pick("er").alias("a"), pick("re").alias("b"))


def _list_table(s: SparkSession, d: str, term: str) -> DataFrame:
    return tf_of(s, d).where(F.col("term") == term).select("doc_id")


def _ids(expression):
    return lambda s, d: _lists(s, d).select(F.explode(expression(F.col("a"), F.col("b"))).alias("doc_id"))


query("postings_build", cte() + f"select term, doc_id // {BLOCK} as block, array_to_string(list(doc_id order by doc_id), ',') as ids from tf group by all")(
    lambda s, d: tf_of(s, d).groupBy("term", F.floor(F.col("doc_id") / BLOCK).alias("block")).agg(as_text(post.new(F.collect_list("doc_id"))).alias("ids"))
)
query("posting_intersect", cte() + f"{_ER} intersect {_RE}")(_ids(post.intersect))
query("posting_union", cte() + f"{_ER} union {_RE}")(_ids(post.union))
query("posting_difference", cte() + f"{_ER} except {_RE}")(_ids(post.difference))
query("posting_remove_set", cte() + f"{_RE} except {_ER}")(_ids(lambda a, b: post.remove_set(b, a)))
query("posting_append_sorted", cte() + f"{_ER} union {_RE}")(_ids(post.append_sorted))
query("posting_intersect_many", cte() + f"select * from ({_ER} intersect {_RE}) where doc_id <= 500")(_ids(lambda a, b: post.intersect_many(a, b, post.within(a, 1, 500))))
query("posting_union_many", cte() + f"{_ER} union {_RE}")(_ids(lambda a, b: post.union_many(b, a, b)))
query("posting_filter", cte() + f"select doc_id from ({_ER}) where doc_id % 3 = 0")(_ids(lambda a, b: post.keep(a, lambda x: x % 3 == 0)))
query("posting_range", cte() + f"select doc_id from ({_ER}) where doc_id between 100 and 400")(_ids(lambda a, b: post.within(a, 100, 400)))
query("posting_add_remove", cte() + f"select doc_id from (({_ER}) union (select block * {BLOCK} + 1 from (select distinct doc_id // {BLOCK} as block from tf where term in ('er', 're')))) where doc_id <> 2")(
    lambda s, d: _lists(s, d).select(F.explode(post.remove(post.add(F.col("a"), F.array(F.col("block") * BLOCK + 1)), F.lit(2))).alias("doc_id"))
)
query("posting_membership", cte() + f"""select b.block, coalesce(bool_or(t.doc_id = b.block * {BLOCK} + 7), false) as has, min(t.doc_id) as low, max(t.doc_id) as high, count(t.doc_id) as n, count(t.doc_id) filter (t.doc_id % {BLOCK} >= 300) as rest, coalesce(bool_or(t.doc_id = b.block * {BLOCK} + 9), false) as gone
    from (select distinct doc_id // {BLOCK} as block from tf where term in ('er', 're')) b left join ({_ER}) t on t.doc_id // {BLOCK} = b.block group by 1""")(
    lambda s, d: _lists(s, d).select(
        "block", post.contains(F.col("a"), F.col("block") * BLOCK + 7).alias("has"), post.lowest(F.col("a")).alias("low"), post.highest(F.col("a")).alias("high"), F.size("a").cast("long").alias("n"),
        post.remaining(F.col("a"), F.col("block") * BLOCK + 300).cast("long").alias("rest"), post.removed(F.col("a"), F.col("block") * BLOCK + 9).alias("gone"),
    )
)
query("posting_equal", cte() + f"select bool_and(same) as same, bool_and(itself) as itself from (select b.block, list(t.doc_id order by doc_id) is not distinct from list(t.doc_id order by doc_id) filter (doc_id in ({_RE})) as same, true as itself from (select distinct doc_id // {BLOCK} as block from tf where term in ('er', 're')) b left join ({_ER}) t on t.doc_id // {BLOCK} = b.block group by 1)")(
    lambda s, d: _lists(s, d).agg(F.bool_and(post.equal(F.col("a"), post.intersect(F.col("a"), F.col("b")))).alias("same"), F.bool_and(post.equal(F.col("a"), post.new(F.reverse("a")))).alias("itself"))
)
query("posting_overlap", cte() + f"select count(*) as n, (select min(doc_id) from ({_ER}) where doc_id >= 300) as seek from (({_ER}) intersect ({_RE}))")(
    lambda s, d: _lists(s, d).agg(F.sum(post.overlap(F.col("a"), F.col("b"))).alias("n"), F.min(post.seek(F.col("a"), 300)).alias("seek"))
)
query("posting_deltas", cte() + f"select doc_id // {BLOCK} as block, row_number() over w - 1 as pos, doc_id - lag(doc_id, 1, 0) over w as delta from ({_ER}) window w as (partition by doc_id // {BLOCK} order by doc_id)")(
    lambda s, d: _lists(s, d).select("block", F.posexplode(post.deltas(F.col("a"))).alias("pos", "delta")).select("block", F.col("pos").cast("long").alias("pos"), "delta")
)
query("posting_from_deltas", cte() + _ER)(_ids(lambda a, b: post.from_deltas(post.deltas(a))))
query("posting_codec_round_trip", cte() + _RE)(_ids(lambda a, b: post.decode(post.encode(b))))
query("posting_raw_round_trip", cte() + _ER)(_ids(lambda a, b: post.decode_raw(post.encode_raw(a))))
query("posting_encoded_size", cte() + f"select b.block, case when count(t.doc_id) = 0 then 1 else 8 + 3 * count(t.doc_id) end as size from (select distinct doc_id // {BLOCK} as block from tf where term in ('er', 're')) b left join ({_ER}) t on t.doc_id // {BLOCK} = b.block group by 1")(
    lambda s, d: _lists(s, d).select("block", post.encoded_size(F.col("a")).cast("long").alias("size"))
)


@query("posting_cursors", cte() + f"select doc_id from (({_ER}) intersect ({_RE})) order by doc_id limit 10")
def posting_cursors(s: SparkSession, d: str) -> DataFrame:
    """The first ten common ids: two cursors seek each other and stop there."""
    found: list[int] = []

    def visit(doc_id: int) -> bool:
        found.append(doc_id)
        return len(found) < 10

    post.intersect_each(post.Cursor(_list_table(s, d, "er")), post.Cursor(_list_table(s, d, "re")), visit)
    return s.createDataFrame([(x,) for x in found], "doc_id long")


# Statistics and scores

query("stats_tf_df", cte() + "select term, cast(sum(tf) as bigint) as count, count(*) as df from tf group by 1")(lambda s, d: stats.term_stats(tf_of(s, d)))
query("stats_top_terms", cte() + "select term, cast(sum(tf) as bigint) as count, count(*) as df from tf group by 1 order by count desc, term limit 20")(lambda s, d: stats.top_terms(tf_of(s, d), 20))


@query(
    "stats_snapshot",
    cte()
    + """, top as (select term, sum(tf) c from tf group by 1 order by c desc, term limit 20)
    select (select count(*) from src) as num_docs, (select count(distinct term) from tf) as num_terms, (select round(avg(length), 6) from lens) as avg_doc_len,
      (select string_agg(term || ':' || c, ',' order by c desc, term) from top) as top_terms""",
)
def stats_snapshot(s: SparkSession, d: str) -> DataFrame:
    row = stats.snapshot(tf_of(s, d), lengths_of(s, d))
    top = F.array_join(F.transform("top_terms", lambda x: F.concat_ws(":", x["term"], x["count"].cast("string"))), ",")
    return row.select("num_docs", "num_terms", F.round("avg_doc_len", 6).alias("avg_doc_len"), top.alias("top_terms"))


query("stats_idf", cte() + ", n as (select count(*) n from src) select term, round(ln((n + 1) / (count(*) + 1)) + 1, 6) as idf from tf, n group by term, n")(
    lambda s, d: stats.term_stats(tf_of(s, d)).join(F.broadcast(ids_of(s, d).agg(F.count("*").alias("n"))), F.lit(True)).select("term", F.round(stats.idf(F.col("n"), F.col("df")), 6).alias("idf"))
)
query("stats_combine", cte() + "select term, cast(2 * sum(tf) as bigint) as count, cast(2 * count(*) as bigint) as df from tf group by 1")(lambda s, d: stats.combine(stats.term_stats(tf_of(s, d)), stats.term_stats(tf_of(s, d))))
_BM25 = """, c as (select count(*) n, avg(length) mean from lens), f as (select term, count(*) df from tf where term in ('er', 're') group by 1)
select doc_id, round(sum((ln((n + 1) / (df + 1)) + 1) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) as score from tf join f using (term) join lens using (doc_id), c group by 1"""
query("bm25_scores", cte() + _BM25)(lambda s, d: stats.bm25_scores(tf_of(s, d), lengths_of(s, d), ["er", "re"]).select("doc_id", F.round("score", 6).alias("score")))
query("bm25_topk", cte() + f"select * from ({_BM25.replace(', c as', 'with c as', 1)}) order by score desc, doc_id limit 10")(
    lambda s, d: plan.ranked(stats.bm25_scores(tf_of(s, d), lengths_of(s, d), ["er", "re"]).select("doc_id", F.round("score", 6).alias("score")), 10)
)


def _hits(s: SparkSession, d: str) -> DataFrame:
    return tf_of(s, d).where(F.col("term").isin("er", "re")).select("doc_id", F.col("tf").cast("double").alias("score"))


query("collect_dedup_hits", cte() + "select doc_id, cast(max(tf) as double) as score from tf where term in ('er', 're') group by 1")(lambda s, d: hits.dedup_hits(_hits(s, d)))
query("collect_idf_boost", cte() + "select src.doc_id, cast(1 + coalesce(tf, 0) * 1.5 as double) as score from src left join (select * from tf where term = 'er') t using (doc_id)")(
    lambda s, d: hits.collect(ids_of(s, d), hits.idf_boost_scorer(tf_of(s, d).where("term = 'er'").select("doc_id", "tf"), 1.5))
)
query("collect_tf_map", cte() + "select src.doc_id, cast(coalesce(sum(tf), 0) as double) as score from src left join (select * from tf where term in ('er', 're')) t using (doc_id) group by 1")(
    lambda s, d: hits.collect(ids_of(s, d), hits.multi_term_scorer(tf_of(s, d).where(F.col("term").isin("er", "re"))))
)
query("collect_filter_live", cte() + "select doc_id, cast(tf as double) as score from tf where term in ('er', 're') and doc_id in (select doc_id + 1 from labels)")(lambda s, d: hits.filter_live(_hits(s, d), table(s, d, "labels").select((F.col("doc_id") + 1).alias("doc_id"))))
query("collect_sorted_by_id", cte() + "select doc_id, cast(tf as double) as score from tf where term in ('er', 're') order by doc_id")(lambda s, d: hits.sort_by_doc_id(_hits(s, d)))

# Changes: documents are added, multiples of 7 deleted, multiples of 13 added again with other text

_LOG = f"""with log as (
  select doc_id as seq, 1 as op, doc_id, text from {DOCS}
  union all select 1000000000 + doc_id, 2, doc_id, '' from {DOCS} where doc_id % 7 = 0
  union all select 2000000000 + doc_id, 1, doc_id, 'again ' || doc_id from {DOCS} where doc_id % 13 = 0),
latest as (select * from log qualify row_number() over (partition by doc_id order by seq desc) = 1)
"""


def _changes(s: SparkSession, d: str) -> DataFrame:
    docs = corpus(s, d)
    row = lambda df, at, op, text: df.select((F.col("doc_id") + at).alias("seq"), F.lit(op).alias("op"), "doc_id", text.alias("text"))
    gone, again = docs.where("doc_id % 7 = 0"), docs.where("doc_id % 13 = 0")
    return row(docs, 0, log.ADD, F.col("text")).unionByName(row(gone, 1_000_000_000, log.DELETE, F.lit(""))).unionByName(row(again, 2_000_000_000, log.ADD, F.concat(F.lit("again "), "doc_id")))


query("upsert_latest", _LOG + "select doc_id, text from latest where op = 1")(lambda s, d: log.live(_changes(s, d)))
query("pending_deletes", _LOG + "select doc_id from latest where op = 2")(lambda s, d: log.pending_deletes(_changes(s, d)))
query("live_universe", _LOG + "select doc_id from latest where op = 1")(lambda s, d: log.live(_changes(s, d)).select("doc_id"))
query("wal_replay", _LOG + "select case op when 1 then 'add' else 'delete' end as name, seq, doc_id, text from log")(
    lambda s, d: log.valid(log.replayed(log.frames(_changes(s, d)))).select(log.op_name(F.col("op")).alias("name"), "seq", "doc_id", "text")
)
_CRC = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
query(
    "wal_crc32",
    f"""with t as (select {_CRC} as crc), b as (select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)) as bytes from {DOCS})
    select doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as crc, true as ok from b, t""",
)(lambda s, d: corpus(s, d).select("doc_id", log.checksum(F.col("text")).alias("crc"), log.verified(F.col("text"), log.checksum(F.col("text"))).alias("ok")))


@query(
    "mem_buffer_stats",
    cte() + "select (select count(*) from src) as docs, (select count(distinct term) from tf) as terms, (select count(*) from src where doc_id % 7 = 0) as deletes, cast((select sum(octet_length(encode(text))) from src) + (select sum(b) from (select octet_length(encode(term)) + 8 * count(*) b from tf group by term)) as bigint) as approx_bytes",
)
def mem_buffer_stats(s: SparkSession, d: str) -> DataFrame:
    docs = index_of(s, d).live_docs().select("doc_id", "text")
    return stats.buffer_stats(docs, tf_of(s, d), docs.where("doc_id % 7 = 0").select("doc_id"))


# Segments: eight, by doc_id % 8; multiples of 5 are dead

_SEG = cte() + """, live as (select doc_id % 8 as segment_id, doc_id from src), post as (select doc_id % 8 as segment_id, doc_id, term from tf),
alive as (select * from live where doc_id % 5 <> 0), alive_post as (select * from post where doc_id % 5 <> 0)
"""


def _segments(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    one = (F.col("doc_id") % 8).alias("segment_id")
    live = ids_of(s, d).select(one, "doc_id")
    return live, tf_of(s, d).select(one, "doc_id", "term"), live.where("doc_id % 5 = 0")


query("segment_meta", _SEG + "select segment_id, count(distinct doc_id) as doc_count, min(doc_id) as min_doc, max(doc_id) as max_doc, (select count(distinct term) from post p where p.segment_id = live.segment_id) as term_count from live group by 1")(
    lambda s, d: seg.metas(*_segments(s, d)[:2])
)
query("segment_score", _SEG + "select segment_id, count(*) * 10 + (select count(distinct term) from post p where p.segment_id = live.segment_id) as score from live group by 1")(
    lambda s, d: seg.metas(*_segments(s, d)[:2]).select("segment_id", seg.score_segment(F.col("doc_count"), F.col("term_count")).alias("score"))
)
query("delete_tombstones", _SEG + "select segment_id, doc_id from alive")(lambda s, d: seg.alive(_segments(s, d)[0], _segments(s, d)[2]))
query("merge_segments", _SEG + "select 9::bigint as segment_id, doc_id, term from alive_post")(lambda s, d: seg.merge(*_segments(s, d), 9)[1])
query("merge_dry_run", _SEG + "select count(distinct doc_id) as doc_count, min(doc_id) as min_doc, max(doc_id) as max_doc, (select count(distinct term) from post) as term_count from live")(lambda s, d: seg.dry_run(*_segments(s, d)[:2]))


@query("merge_verify", _SEG + "select 'x' as problem, doc_id, '' as term from live where false")
def merge_verify(s: SparkSession, d: str) -> DataFrame:
    """Postings are dealt out by document once, in portions that do not grow with the corpus, for the merge and its check."""
    live, postings, dead = _segments(s, d)
    tables = live, dealt(postings, "doc_id", each=4 << 20), dead
    return seg.merge_problems(*tables, *seg.merge(*tables, 9))


query("needs_compaction", _SEG + "select count(*) >= 8 or count(*) filter (n < 32) >= 2 as needed from (select segment_id, count(*) n from live group by 1)")(
    lambda s, d: s.createDataFrame([(seg.Policy().needs_compaction([seg.Meta(r["segment_id"], r["doc_count"], 0, 0, 0) for r in seg.metas(*_segments(s, d)[:2]).collect()]),)], "needed boolean")
)

query("merge_estimate", _SEG + "select count(distinct doc_id) as docs from alive where segment_id < 3")(lambda s, d: seg.estimate_merged(_segments(s, d)[0].where("segment_id < 3"), _segments(s, d)[2]))
query("segment_set", _SEG + "select string_agg(distinct segment_id::varchar, ',' order by segment_id::varchar) as ids, count(distinct segment_id) as n, count(distinct doc_id) as docs from alive where segment_id not in (0, 7)")(lambda s, d: _segment_set(s, d))


def _metas(s: SparkSession, d: str) -> list[seg.Meta]:
    rows = seg.metas(*_segments(s, d)[:2]).collect()
    return [seg.Meta(r["segment_id"], r["doc_count"], r["min_doc"], r["max_doc"], r["term_count"]) for r in rows]


def _segment_set(s: SparkSession, d: str) -> DataFrame:
    live, _, dead = _segments(s, d)
    some = seg.SegmentSet(live, dead, [m for m in _metas(s, d) if m.id != 0])
    some.remove(7)
    ids = some.ids()
    return some.total_docs().select(F.lit(",".join(map(str, ids))).alias("ids"), F.lit(len(some)).cast("long").alias("n"), "docs")


@query("merge_plan", _SEG + "select segment_id as source, 100::bigint as target, segment_id not in (select segment_id from live group by 1 order by count(*), segment_id limit 2) as stays from live group by 1")
def merge_plan(s: SparkSession, d: str) -> DataFrame:
    metas = _metas(s, d)
    ids, target = seg.Policy().plan(metas, 100)
    rest = {m.id for m in seg.exclude_ids(metas, ids)}
    return s.createDataFrame([(m.id, target, m.id in rest) for m in seg.select_ids(metas, [m.id for m in metas])], "source long, target long, stays boolean")


@query("segment_build", cte() + "select 1::bigint as segment_id, doc_id, term from tf where doc_id <= 20 and doc_id % 2 = 1")
def segment_build(s: SparkSession, d: str) -> DataFrame:
    """A small segment from documents that are added one by one, some of them deleted again."""
    builder = seg.Builder()
    for r in an.term_lists(corpus(s, d).where("doc_id <= 20")).collect():
        builder.add_doc(r["doc_id"], [*r["terms"], ""])
        if r["doc_id"] % 2 == 0:
            builder.delete_doc(r["doc_id"])
    return seg.build(*builder.build(s, 1))


# Indexes that change: all documents flushed, then the deletes and second versions of the log above

_NOW = f"""select doc_id, text from (select * from (select 1 as seq, 1 as op, doc_id, text from {DOCS} union all select 2, 2, doc_id, '' from {DOCS} where doc_id % 7 = 0
  union all select 3, 1, doc_id, 'er again er ' || doc_id from {DOCS} where doc_id % 13 = 0) qualify row_number() over (partition by doc_id order by seq desc) = 1) where op = 1"""


def _second(s: SparkSession, d: str) -> DataFrame:
    """Deletes, then second versions, as one batch."""
    ids = corpus(s, d).select("doc_id")
    row = lambda df, seq, op, text: df.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "doc_id", text.alias("text"))
    gone = row(ids.where("doc_id % 7 = 0"), 0, log.DELETE, F.lit(""))
    return gone.unionByName(row(ids.where("doc_id % 13 = 0"), 1, log.ADD, F.concat(F.lit("er again er "), "doc_id")))


def _changed(s: SparkSession, d: str, kind: str) -> SearchIndex:
    """kind: logged (the second batch is in the log only), flushed (two segments) or merged (one again)."""

    def fill(index: SearchIndex) -> None:
        index.add_all(corpus(s, d))
        index.flush()
        index.apply(_second(s, d))
        if kind != "logged":
            index.flush()

    return _built(s, d, kind, fill, merge_policy=seg.Policy(2 if kind == "merged" else 8, 10_000, 2 if kind == "merged" else 9))


_HITS = cte(_NOW) + "select doc_id, cast(tf as double) as score from tf where term = 'er' and doc_id not in (select doc_id from tf where term = 're') order by score desc, doc_id limit 10000"
query("index_search", _HITS)(lambda s, d: _changed(s, d, "flushed").search(" er AND NOT re"))
query("index_search_unflushed", _HITS)(lambda s, d: _changed(s, d, "logged").search(And(Term("Er "), Not(Term("re")))))
query("index_search_merged", _HITS)(lambda s, d: _changed(s, d, "merged").search("er and not (re or re)"))
query("index_search_doc_ids", cte(_NOW) + "select distinct doc_id from tf where term in ('er', 're') order by 1")(lambda s, d: _changed(s, d, "flushed").search_doc_ids("er or re"))
query("index_brute_force", cte(_NOW) + f"select doc_id from ({_ER}) where doc_id not in ({_RE})")(lambda s, d: _changed(s, d, "flushed").brute_force("er and not re"))
query("index_delete", f"select doc_id, md5(text) as text_md5 from ({_NOW})")(lambda s, d: _changed(s, d, "flushed").live_docs().select("doc_id", F.md5("text").alias("text_md5")))
query("index_reopen", cte(_NOW) + "select doc_id, term, tf from tf")(lambda s, d: _changed(s, d, "logged").live_tf())
query("index_posting", cte(_NOW) + _ER)(lambda s, d: _changed(s, d, "logged").posting(" ER"))
query("index_snapshot", cte(_NOW) + _ER)(lambda s, d: _changed(s, d, "flushed").snapshot().posting("er"))
query("index_merge", cte(_NOW) + "select 3::bigint as segment_id, count(*) as doc_count, min(doc_id) as min_doc, max(doc_id) as max_doc, (select count(distinct term) from tf) as term_count from src")(
    lambda s, d: s.createDataFrame([(m.id, m.doc_count, m.min_doc, m.max_doc, m.term_count) for m in _changed(s, d, "merged").segment_metas()], "segment_id long, doc_count long, min_doc long, max_doc long, term_count long")
)
query("index_segment", cte(_NOW.replace("where op = 1", "where op = 1 and seq = 1")) + "select term, doc_id from tf")(lambda s, d: _changed(s, d, "flushed").segment(1).all_postings())
query("index_segment_terms", cte(_NOW.replace("where op = 1", "where op = 1 and seq = 3")) + "select distinct term from tf")(lambda s, d: _changed(s, d, "flushed").segment(2).terms())
query("index_segment_set", f"select count(*) as docs from ({_NOW})")(lambda s, d: _changed(s, d, "flushed").segments().total_docs())
query("index_tombstones", f"select 1::bigint as segment_id, doc_id from {DOCS} where doc_id % 7 = 0 or doc_id % 13 = 0")(lambda s, d: _changed(s, d, "flushed").tombstones())


@query(
    "index_lookups",
    f"select n.doc_id, t.doc_id is not null as has, md5(t.text) as text_md5, t.doc_id is not null as live from (select unnest([1, 7, 13, 91]) as doc_id) n left join ({_NOW}) t using (doc_id)",
)
def index_lookups(s: SparkSession, d: str) -> DataFrame:
    """Point reads of four documents."""
    index = _changed(s, d, "flushed")
    now = index.snapshot()
    rows = [(x, index.has_doc(x), index.doc_text(x), now.is_live(x)) for x in (1, 7, 13, 91)]
    return s.createDataFrame(rows, "doc_id int, has boolean, text string, live boolean").select("doc_id", "has", F.md5("text").alias("text_md5"), "live")


@query("index_catalog", f"select 2::bigint as segments, (select count(*) from ({_NOW})) as docs, 0::bigint as unflushed, 3::bigint as next_id, true as closed")
def index_catalog(s: SparkSession, d: str) -> DataFrame:
    with _changed(s, d, "flushed") as index:
        row = (index.segment_count(), index.snapshot().doc_count(), index.mem_doc_count(), index.store.load_manifest()["next_id"])
    return s.createDataFrame([(*row, index.closed)], "segments long, docs long, unflushed long, next_id long, closed boolean")


# Statistics that change, and other scalars

query("stats_put_drop", cte() + "select term, cast(sum(tf) as bigint) as count, count(*) as df from (select doc_id, term, tf from tf where doc_id % 5 <> 0 and doc_id % 7 <> 0 union all select doc_id, 'fresh', 2 from src where doc_id % 7 = 0 and doc_id % 5 <> 0) group by 1")(
    lambda s, d: stats.term_stats(stats.drop(stats.put(tf_of(s, d), ids_of(s, d).where("doc_id % 7 = 0").select("doc_id", F.lit("fresh").alias("term"), F.lit(2).cast("long").alias("tf"))), ids_of(s, d).where("doc_id % 5 = 0")))
)
query("stats_doc_tf", cte() + "select coalesce(sum(tf), 0)::bigint as tf from tf where doc_id = 3 and term = 'er'")(lambda s, d: stats.tf_in(tf_of(s, d), 3, "er"))
query("normalize_all", "select item_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda x: lower(trim(x))), lambda x: x <> ''), ',') as terms from benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", as_text(strings.normalize_all(F.split("text", " ", -1))).alias("terms"))
)
query("is_ident", "select item_id, regexp_full_match(substr(text, 1, 1), '[A-Za-z0-9_]') as first, regexp_full_match(substr(text, 5, 1), '[A-Za-z0-9_]') as fifth from benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", *[strings.is_ident(F.substring("text", i, 1)).alias(n) for i, n in ((1, "first"), (5, "fifth"))])
)
query("filter_merged_stopwords", _filter_sql(f"term not in ({STOP}, 'die', 'er')"))(_filtered(an.Stopwords(an.merge_stopwords(an.STOPWORDS, an.stopword_list(" Die", "ER", "")))))
query("query_text", """select 'OR("die", AND("er", NOT(OR("re", "de"))))' as text, false as empty, true as no_term""")(
    lambda s, d: s.createDataFrame([(str(parse("die or er and not (RE or de)")), parse("die").is_empty(), Term(" ").is_empty())], "text string, empty boolean, no_term boolean")
)

# Other corpora

_OTHER = {
    "conversations_search": ("select conv_id * 1000 + turn + 1 as doc_id, text from conversations", "conversations", "conv_id * 1000 + turn + 1", "text", "der"),
    "pages_search": ("select page_id + 1 as doc_id, html as text from pages", "pages", "page_id + 1", "html", "div"),
    "events_log_search": ("select event_id + 1 as doc_id, concat(event_type, ' ', props) as text from events", "events", "event_id + 1", "concat(event_type, ' ', props)", "purchase"),
}
for _name, (_sql, _table, _id, _text, _term) in _OTHER.items():
    query(_name, cte(_sql) + f"select doc_id, cast(tf as double) as score from tf where term = '{_term}'")(
        lambda s, d, t=_table, i=_id, x=_text, w=_term: an.term_freq(table(s, d, t).selectExpr(f"{i} as doc_id", f"{x} as text")).where(F.col("term") == w).select("doc_id", F.col("tf").cast("double").alias("score"))
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked Boolean search over the corpus."""
    return QUERIES["search_scored_topk"](spark, sf_dir)
