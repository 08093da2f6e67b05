"""Corpus statistics over tf(doc_id, term, tf) and lengths(doc_id, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doc_tf(tf: DataFrame) -> DataFrame:
    """The frequencies that count: positive ones."""
    return tf.where("tf > 0")


def put(table: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all rows of the documents in `new`."""
    return drop(table, new).unionByName(new)


def drop(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the rows of these documents; it is not sorted for that, a task holds its share of the ids."""
    return table.join(ids.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti")


def term_stats(tf: DataFrame) -> DataFrame:
    """(term, count, df)."""
    return doc_tf(tf).groupBy("term").agg(F.sum("tf").alias("count"), F.count("*").alias("df"))


def top_terms(tf: DataFrame, k: int) -> DataFrame:
    """The k terms of largest count, ties in byte order; k <= 0 gives none."""
    return term_stats(tf).orderBy(F.desc("count"), "term").limit(max(0, k))


def tf_in(tf: DataFrame, doc_id: int, term: str) -> DataFrame:
    """One row, tf: how often a document has a term; 0 where it has it not."""
    return doc_tf(tf).where((F.col("doc_id") == doc_id) & (F.col("term") == term)).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"))


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Add up two (term, count, df) tables."""
    return a.unionByName(b).groupBy("term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def average_length(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_doc_len"))


def snapshot(tf: DataFrame, lengths: DataFrame, top_k: int = 20) -> DataFrame:
    """One row: num_docs, num_terms, avg_doc_len, top_terms (array of term, count, df). Each part is one row before they meet."""
    docs = lengths.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_doc_len"))
    terms = term_stats(tf).agg(F.count("*").alias("num_terms"))
    top = top_terms(tf, top_k).agg(F.collect_list(F.struct(F.negative("count").alias("neg"), "term", "count", "df")).alias("t"))
    top = top.select(F.transform(F.array_sort("t"), lambda x: F.struct(x["term"].alias("term"), x["count"].alias("count"), x["df"].alias("df"))).alias("top_terms"))
    one = F.lit(1).alias("one")
    return docs.select("*", one).join(terms.select("*", one), "one").join(top.select("*", one), "one").select("num_docs", "num_terms", "avg_doc_len", "top_terms")


def ln(x: Column) -> Column:
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.log(x))


def idf(num_docs: Column, df: Column) -> Column:
    """ln((N + 1) / (df + 1)) + 1; negative numbers count as 0."""
    n, d = (F.greatest(x.cast("double"), F.lit(0.0)) for x in (num_docs, df))
    return ln((n + 1) / (d + 1)) + 1


def bm25(tf: Column, df: Column, num_docs: Column, length: Column, avg_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Okapi weight; a zero denominator gives 0, and parameters out of range their defaults."""
    k1, b = k1 if k1 > 0 else 1.2, b if b >= 0 else 0.75
    mean = F.when(avg_length <= 0, F.lit(1.0)).otherwise(avg_length)
    denominator = tf + k1 * (1 - b + b * length / mean)
    return F.when(denominator == 0, F.lit(0.0)).otherwise(idf(num_docs, df) * (tf * (k1 + 1)) / denominator)


def bm25_scores(tf: DataFrame, lengths: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score): sum over the distinct terms. Document counts come as one row, term counts as one for each term asked for."""
    asked = doc_tf(tf).where(F.col("term").isin(*sorted(set(terms))))
    per_term = asked.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
    rows = asked.join(F.broadcast(per_term), "term").join(lengths, "doc_id").join(F.broadcast(corpus.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))
    return rows.groupBy("doc_id").agg(F.sum(bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("mean"), k1, b)).alias("score"))


def buffer_stats(docs: DataFrame, tf: DataFrame, deletes: DataFrame) -> DataFrame:
    """One row: docs, terms, deletes and approximate bytes of unflushed changes."""
    one = F.lit(1).alias("one")
    text = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"))
    lists = tf.groupBy("term").agg((F.octet_length("term") + 8 * F.count("*")).alias("b")).agg(F.count("*").alias("terms"), F.coalesce(F.sum("b"), F.lit(0)).alias("list_bytes"))
    gone = deletes.agg(F.count("*").alias("deletes"))
    rows = text.select("*", one).join(lists.select("*", one), "one").join(gone.select("*", one), "one")
    return rows.select("docs", "terms", "deletes", (F.col("text_bytes") + F.col("list_bytes")).alias("approx_bytes"))
