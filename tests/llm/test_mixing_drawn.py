"""op2 tells what the shards have drawn, not what was planned."""

from pyspark.sql import functions as F

from quern.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_op2_runs_the_tree(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 50), f"s{i % 3}") for i in range(300)] + [(7, "w " * 7, "s1")], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan, copies = mixing.mix(df)
    assert plan.where("taken <> words_drawn").count() == 0
    sums = mixing.op2_source_mixing(spark, str(tmp_path)).agg(F.sum("taken")).first()[0]
    assert sums == copies.agg(F.sum("words")).first()[0] > 0
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: tree(*a).where("src is null"))
    assert mixing.op2_source_mixing(spark, str(tmp_path)).agg(F.sum("taken")).first()[0] == 0
