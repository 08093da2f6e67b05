"""Queries to DataFrames over postings, and to Columns over term arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import let
from quern.plans.query import Kind, Query, term_weights


def matching(q: Query, postings: DataFrame, universe: DataFrame) -> DataFrame:
    """doc_id of the documents that q matches. postings(doc_id, term, ...): one row for each pair; universe(doc_id).

    Terms of one AND or OR are read in one pass of the postings, filtered on `term`; only mixed nodes join.
    """
    ids = universe.select("doc_id")
    if q.kind is Kind.TERM:
        return postings.where(F.col("term") == q.term).select("doc_id")
    if q.kind is Kind.NOT:
        return ids.join(matching(q.kids[0], postings, universe), "doc_id", "left_anti")
    terms = sorted({k.term for k in q.kids if k.kind is Kind.TERM})
    others = [k for k in q.kids if k.kind is not Kind.TERM]
    own = None
    if terms:
        own = postings.where(F.col("term").isin(*terms))
        if q.kind is Kind.OR:
            own = own.select("doc_id").distinct()
        elif len(terms) == 1:
            own = own.select("doc_id")
        else:
            own = own.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("doc_id")
    if q.kind is Kind.OR:
        parts = [matching(k, postings, universe) for k in others] + ([own] if own is not None else [])
        return reduce(DataFrame.unionByName, parts).distinct() if len(parts) > 1 else parts[0]
    out = ids if own is None else own
    for k in sorted(others, key=lambda k: k.kind is Kind.NOT):
        inner, how = (k.kids[0], "left_anti") if k.kind is Kind.NOT else (k, "left_semi")
        out = out.join(matching(inner, postings, universe), "doc_id", how)
    return out


def predicate(q: Query | None, terms: Column) -> Column:
    """The same as a condition on an array of a document's terms, which is computed once, however many terms q has."""
    return F.lit(False) if q is None else let(terms, lambda known: _holds(q, known))


def _holds(q: Query, terms: Column) -> Column:
    if q.kind is Kind.TERM:
        return F.array_contains(terms, q.term)
    kids = [_holds(k, terms) for k in q.kids]
    if not kids:
        return F.lit(False)
    if q.kind is Kind.NOT:
        return ~kids[0]
    return reduce((lambda a, b: a & b) if q.kind is Kind.AND else (lambda a, b: a | b), kids)


def in_order(ids: DataFrame) -> DataFrame:
    """doc_id, sorted. Ids are dealt out first: a sort reads its input twice, to find its ranges, and this way that is the ids alone."""
    return ids.select("doc_id").repartition("doc_id").orderBy("doc_id")


def weighted_tf(q: Query, postings: DataFrame) -> DataFrame:
    """(doc_id, score): term frequencies of q's terms, each as often as it stands in q."""
    weights = term_weights(q)
    weight = reduce(lambda c, t: c.when(F.col("term") == t, weights[t]), sorted(weights), F) if weights else F.lit(0)
    return postings.where(F.col("term").isin(*sorted(weights))).groupBy("doc_id").agg(F.sum(F.col("tf") * weight).cast("double").alias("score"))


def ranked(hits: DataFrame, limit: int | None) -> DataFrame:
    """Best score first, ties to the smaller id; no limit if it is None or not positive."""
    hits = hits.select("doc_id", "score").orderBy(F.desc("score"), "doc_id")
    return hits.limit(limit) if limit and limit > 0 else hits
