"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import crc_mod, staged


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, max_docs: int, max_chars: int) -> pd.DataFrame:
    """Whole texts of at most max_docs labelled documents outside the held-out remainder: (_id, text, y).

    The documents with the smallest hashes of their ids come, the same on every run; one that would take the
    sum of the texts over max_chars is passed over, and the next ones are tried. So the driver gets a bounded
    table. Ids with several labels have the largest, ids with several texts the smallest; null labels and ids are left
    out. Labelled documents of which none fits are an error; no labelled documents give an empty table.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(crc_mod(F.col("doc_id"), mod) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = staged(texts.join(chosen, "_id").groupBy("_id", "y").agg(F.min("text").alias("text")), "labelled")
    fits, left = [], max_chars
    for r in rows.select("_id", F.xxhash64("_id").alias("h"), F.length("text").alias("n")).orderBy("h", "_id").collect():
        if r["n"] <= left:
            fits.append(r["_id"])
            left -= r["n"]
    if not fits and not rows.isEmpty():
        raise ValueError(f"no labelled text has at most {max_chars} characters")
    ids = rows.sparkSession.createDataFrame([(x,) for x in fits], "_id long")
    return rows.join(F.broadcast(ids), "_id", "left_semi").select("_id", "text", "y").toPandas().sort_values("_id", ignore_index=True)
