"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame operations only.

1. Targets: sources by code point, null last, weigh 5, 2, 1 and again; together they get the corpus'
   size, none more than `cap` times its own (the excess goes to the others by weight).
2. Blocks: a seeded hash deals each source's documents into blocks of about `block_words`; a target is
   so many whole passes over the source's blocks and one partial pass over its first blocks in a
   seeded permutation. Inside the one block that the partial pass cuts, documents are taken in seeded
   order and the last one by its leading words, so taken words meet the target to within a word.
3. Tree: at every level each node permutes the block tickets it holds and gives the first half to its
   left child, which draws each source's share from the multivariate hypergeometric distribution; the
   leaves are the output shards, each with an exact block quota for each source.
4. Shards draw disjoint runs of the permuted blocks to fill their quotas, and order copies by a seeded hash.

The block table has at most `max_blocks` rows and one for each source, whatever the size of the input;
windows over it are small. Documents meet only map-side combined sums and joins with that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm._common import WORD, staged

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of characters other than the ASCII blanks; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """sizes(source, source_size) -> with weight and target; a row for each source, so windows over it are small."""
    every = W.partitionBy(F.lit(0))
    turn = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(cap))
    by_ratio = every.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("rate", rest / F.sum("weight").over(after))
    fits = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "rate"))).over(every)
    rate = fits["rate"]
    target = F.when(rate.isNull(), F.col("limit")).otherwise(F.least("limit", rate * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _hash(seed: int, *cols) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas(src, quota) -> (shard, src, quota), `shards` a power of two: recursive exact halving of the tickets."""
    tickets = quotas.where("quota > 0").select("src", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("ticket")).withColumn("shard", F.lit(0))
    for level in range(max(0, shards.bit_length() - 1)):
        node = W.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(_hash(seed, F.lit(level), "src", "ticket"), "src", "ticket"))
        right = rank * 2 > F.count("*").over(node) + F.pmod(_hash(seed, F.lit(level), "shard"), F.lit(2))
        tickets = tickets.select("src", "ticket", (F.col("shard") * 2 + right.cast("int")).alias("shard"))
    return tickets.groupBy("shard", "src").agg(F.count("*").alias("quota"))


def mix(docs: DataFrame, *, weights=WEIGHTS, cap: float = 3.0, seed: int = 0, block_words: int = 4096, max_blocks: int = 4096, shards: int = 64, max_bytes: int = 8 << 20):
    """(plan, copies). plan has a row for each document: doc_id, source, size, source_size, target, taken,
    words_drawn (what the shards drew of it),
    and copies a row for each draw of a document: doc_id, tie, source, size, pass, words, shard, place.

    Rows that repeat an id, source and size share their draws. Nulls: a null text has size 0, a null source is a source, a null
    doc_id an id. Sizes of 0 are taken 0 times and drawn never. An empty table gives empty results.
    The plan is the same on every run: all order comes from seeded hashes of id, source, size and text.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie"),
    )
    base = staged(base.withColumn("order", _hash(seed, "doc_id", "tie", "size")), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rows = staged(source_targets(sizes.select("source", "source_size"), weights, cap).withColumn("src", F.xxhash64("source", F.col("source").isNull())), "mix-sources")
    total = rows.agg(F.sum("source_size"), F.count("*")).first()
    block = max(block_words, -(-int(total[0] or 0) // max_blocks), 1)
    rows = rows.withColumns({
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("int"),
        "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int"),
    }).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("source_size"))).cast("long"))
    small = F.broadcast(rows) if total[1] <= 100_000 else rows
    dealt = base.join(small, base["source"].eqNullSafe(rows["source"]), "inner").drop(rows["source"])
    dealt = dealt.withColumn("block", F.pmod("order", F.col("blocks")).cast("int"))

    sums = dealt.groupBy("src", "block").agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    perm = W.partitionBy("src").orderBy(_hash(seed, F.lit("perm"), "src", "block"), "block")
    end = F.sum("block_size").over(perm)
    blocks = sums.withColumns({"rank": F.row_number().over(perm) - 1, "before": end - F.col("block_size")})
    blocks = blocks.withColumn("drawn", F.greatest(F.lit(0), F.least("block_size", F.col("rest") - F.col("before"))))
    blocks = blocks.withColumn("copies", F.col("passes") + (F.col("drawn") > 0).cast("int"))
    blocks = staged(blocks.select("src", "block", "rank", "drawn", "block_size", "passes", "copies"), "mix-blocks")

    state = blocks.select("src", "block", "drawn", "block_size")
    known = dealt.join(F.broadcast(state) if total[1] <= 100_000 else state, ["src", "block"])
    cut = (F.col("drawn") > 0) & (F.col("drawn") < F.col("block_size"))
    whole = known.where(~cut).withColumn("part", F.when(F.col("drawn") > 0, F.col("size")).otherwise(F.lit(0)))
    inside = W.partitionBy("src", "block").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("size").over(inside), F.lit(0))
    partly = known.where(cut).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("drawn") - seen)))
    both = whole.unionByName(partly)
    plan = both.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"), "passes", F.col("part").cast("long").alias("part"), "src", "block", "order", "tie")

    leaves = split_tree(blocks.groupBy("src").agg(F.sum("copies").alias("quota")), shards, seed)
    by_shard = W.partitionBy("src").orderBy("shard")
    leaves = leaves.withColumn("hi", F.sum("quota").over(by_shard)).withColumn("lo", F.col("hi") - F.col("quota"))
    draws = blocks.where("copies > 0").select("src", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass"))
    turn = F.row_number().over(W.partitionBy("src").orderBy(_hash(seed, F.lit("draw"), "src", "block", "pass"), "block", "pass")) - 1
    draws = draws.withColumn("turn", turn).join(leaves, "src").where("turn >= lo and turn < hi").select("src", "block", "pass", "shard")
    copies = plan.where("size > 0").join(draws, ["src", "block"])
    words = F.when(F.col("pass") <= F.col("passes"), F.col("size")).otherwise(F.col("part"))
    copies = copies.select("doc_id", "tie", "source", "size", "pass", words.alias("words"), "shard", _hash(seed, F.lit("place"), "order", "pass").alias("place")).where("words > 0")
    held = draws.groupBy("src", "block").agg(F.collect_list("pass").alias("held"))
    plan = plan.join(F.broadcast(held) if total[1] <= 100_000 else held, ["src", "block"], "left")
    whole = F.size(F.filter("held", lambda x: x <= F.col("passes")))
    words_drawn = F.when(F.col("held").isNull(), F.lit(0)).otherwise(whole * F.col("size") + (F.size("held") - whole) * F.col("part")).cast("long")
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", words_drawn.alias("words_drawn"), "passes", "part", "tie"), copies


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the mixed documents, a folder for each shard, in shuffled order inside it."""
    mixed_rows(docs, keep_plan=True, **options).write.partitionBy("shard").parquet(path)


def mixed_rows(docs: DataFrame, keep_plan: bool = False, **options) -> DataFrame:
    """The mix itself: every document as often as it is drawn, with its own columns, shard by shard and in shuffled order
    inside a shard. The one document of a source that is cut has its leading words, joined by one space.
    keep_plan adds the columns shard and place."""
    _, copies = mix(docs, **options)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*key).alias("key"), text.alias("text"))
    names = ["doc_id", "tie", "source", "size"]
    draws = copies.groupBy(*names).agg(F.array_distinct(F.collect_list(F.struct("words", "shard", "place", "pass"))).alias("draws"))
    draws = draws.select(F.struct(*names).alias("drawn"), "draws")
    same = F.lit(True)
    for k in names:
        same = same & F.col(f"key.{k}").eqNullSafe(F.col(f"drawn.{k}"))
    rows = keyed.join(draws, same).select("row", "key", "text", F.explode("draws").alias("draw"))
    leading = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.greatest(F.lit(1), F.col("draw.words").cast("int"))), " ")
    cut = F.when(F.col("draw.words") < F.col("key.size"), leading).otherwise(F.col("row.text"))
    rows = rows.select("row", cut.alias("text"), F.col("draw.shard").alias("shard"), F.col("draw.place").alias("place"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place")
    out = [F.col("text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*out, *[F.col(c) for c in ("shard", "place") if keep_plan])


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", F.col("words_drawn").alias("taken"))
