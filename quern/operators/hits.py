"""Hits (doc_id, score): scorers and their combinations. A scorer is a function from a DataFrame with doc_id to one with score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.compile import ranked

Scorer = Callable[[DataFrame], DataFrame]


def const_scorer(value: float = 1.0) -> Scorer:
    return lambda ids: ids.select("doc_id", F.lit(float(value)).alias("score"))


def table_scorer(scores: DataFrame) -> Scorer:
    """scores(doc_id, score); documents without a row score 0."""
    return lambda ids: ids.select("doc_id").join(scores, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def idf_boost_scorer(tf: DataFrame, idf: float, base: float = 0.0) -> Scorer:
    """base + tf * idf; a base of 0 means 1. tf(doc_id, tf)."""
    start = float(base or 1.0)
    return lambda ids: ids.select("doc_id").join(tf, "doc_id", "left").select("doc_id", (start + F.coalesce(F.col("tf").cast("double"), F.lit(0.0)) * idf).alias("score"))


def multi_term_scorer(tf: DataFrame) -> Scorer:
    """Sum of tf(doc_id, term, tf) over all its terms."""
    return table_scorer(tf.groupBy("doc_id").agg(F.sum("tf").cast("double").alias("score")))


def collect(ids: DataFrame, scorer: Scorer | None = None, limit: int | None = None) -> DataFrame:
    """Score all ids, then rank and cut."""
    return ranked((scorer or const_scorer())(ids), limit)


def dedup_hits(hits: DataFrame) -> DataFrame:
    """The best score of each document, ranked."""
    return ranked(hits.groupBy("doc_id").agg(F.max("score").alias("score")), None)


def doc_ids(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id")


def sort_by_doc_id(hits: DataFrame) -> DataFrame:
    return hits.orderBy("doc_id")


def filter_live(hits: DataFrame, live: DataFrame) -> DataFrame:
    """Hits of live documents; an empty live table lets all pass."""
    none_live = live.limit(1).agg((F.count("*") == 0).alias("none"))
    kept = hits.join(live.select("doc_id").distinct().withColumn("live", F.lit(True)), "doc_id", "left")
    return kept.join(F.broadcast(none_live), F.col("live").isNotNull() | F.col("none")).select(*hits.columns)
