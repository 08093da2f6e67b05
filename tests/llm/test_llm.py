"""Each operator against brute force on small tables with nulls, ties, repeated rows, empty and long texts and extra columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import byte_bpe, components, crf, exact_dedup, line_dedup, mixing, quality, rp_forest, simhash_dedup, substring_dedup, suffix_lm, toxicity, training

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(seed=0, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Étude", "ÄB", "x y"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 14, 30, 90]))) for _ in range(n)]
    texts += [texts[i] for i in range(0, n, 4)] + [t.upper() for t in texts[:5]] + [None, "", "   ", "\n\n", "a " * 3000]
    body = texts[3] + " " + " ".join(texts[5:9])
    texts += [body + " tail", "head " + body, body.replace("w1 ", "w2 ", 1)]
    out = [(i * 3 % 101, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", None) for i, t in enumerate(texts)]
    return out + [out[2], (None, "w1 w2", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "fp": F.lit("x"), "size": F.lit(2), "node": F.lit(3)})
    return rows, df


def words(text):
    return (text or "").encode().split()


def test_exact_dedup(spark, docs):
    rows, df = docs
    low = lambda t: (t or "").encode().lower()
    top, size = {}, Counter(low(r[1]) for r in rows)
    for r in rows:
        top[low(r[1])] = max(top.get(low(r[1]), -1), -1 if r[0] is None else r[0])
    for options in ({}, {"key": lambda c: F.length(c).cast("long"), "capacity": 2}):
        got = exact_dedup.exact_dedup(df, **options).collect()
        assert len(got) == len(rows)
        want = sorted((str(r[0]), hashlib.sha256(low(r[1])).hexdigest(), top[low(r[1])], size[low(r[1])]) for r in rows)
        assert sorted((str(g.doc_id), g.text_sha256, -1 if g.keep_id is None else g.keep_id, g.group_size) for g in got) == want
        assert all(g.kept == (g.doc_id == g.keep_id) for g in got)
    kept = exact_dedup.kept_rows(df)
    assert kept.columns == df.columns and kept.count() == len(size)
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


def test_directory_splits(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    d = exact_dedup.grow_directory(keys, 100)
    cells = d.cells(spark, 4)
    assert cells.count() == 1 << d.depth and {r.owner for r in cells.collect()} == set(range(4))
    filed = keys.withColumn("cell", exact_dedup.cell_of(F.col("key"), d.depth)).join(cells, "cell").groupBy("owner", "bucket").count().collect()
    assert max(r["count"] for r in filed) <= 100 and sum(r["count"] for r in filed) == 2000
    assert sum(1 / (1 << depth) for _, depth, _ in d.buckets) == 1 and {r.bucket: r["count"] for r in filed} == {i: n for i, (_, _, n) in enumerate(d.buckets) if n}
    assert exact_dedup.grow_directory(keys.where("key = 0"), 5).depth == 0
    hot = spark.range(500).select(F.lit(7).cast("long").alias("key"))
    assert max(n for _, _, n in exact_dedup.grow_directory(hot, 5, 8).buckets) == 500  # one key cannot be split


def test_exact_index_on_files(spark, tmp_path):
    """The registered query's operator: splits, owners, chains of collisions, hot keys, and the files it leaves."""
    rows = [(i, f"Text {i % 300}" if i % 3 else "Hot one") for i in range(1500)] + [(5000, None), (5001, ""), (None, "TEXT 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "owner": F.lit(1), "body": F.lit(2), "rows": F.lit(0), "row": F.lit(9), "_id": F.lit(3)})
    low = lambda t: (t or "").lower()
    size = Counter(low(t) for _, t in rows)
    top = {}
    for i, t in rows:
        top[low(t)] = max(top.get(low(t), -1), -1 if i is None else i)
    for k, key in enumerate((F.xxhash64, lambda c: F.length(c).cast("long"))):
        path = str(tmp_path / str(k))
        index = exact_dedup.ExactIndex(docs, key=key, path=path)
        got = index.lookup().collect()
        assert sorted((str(g.doc_id), g.keep_id, g.group_size) for g in got) == sorted((str(i), top[low(t)], size[low(t)]) for i, t in rows)
        buckets = spark.read.parquet(f"{path}/buckets")
        assert index.hot is not None and buckets.where("hot").count() >= 1 and buckets.count() < len(rows)
        assert buckets.select("bucket", "owner").distinct().count() == buckets.select("bucket").distinct().count()
        assert (buckets.agg(F.max("links")).first()[0] > 1) == (k == 1)
        assert k == 1 or index.directory.depth > 0
        kept = exact_dedup.kept_rows(docs, key=key)
        assert kept.columns == docs.columns and sorted((r.doc_id, r._id) for r in kept.collect()) == sorted((i, 3) for i in top.values())


def test_mixing(spark, docs):
    rows, df = docs
    plan, copies = mixing.mix(df, block_words=50, shards=4)
    got = plan.collect()
    assert len(got) == len(rows) and all(g["size"] * 3 >= g.taken >= 0 for g in got)
    total = sum(len(words(r[1])) for r in rows)
    own, taken, target = Counter(), Counter(), {}
    for g in got:
        own[g.source] += g["size"]
        taken[g.source] += g.taken
        target[g.source] = g.target
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(order), float(total)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 3 * own[s]}
        if not over:
            want |= {s: rate * weight[s] for s in open_}
            break
        want |= {s: 3.0 * own[s] for s in over}
        left -= sum(3 * own[s] for s in over)
        open_ -= over
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1 for s in order)
    again = mixing.mix(df.repartition(3), block_words=50, shards=4)[0].collect()
    key = lambda g: (str(g.doc_id), g["size"], str(g.source), g.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert copies.agg(F.sum("words")).first()[0] == sum(taken.values())
    shard = Counter(r["shard"] for r in copies.select("shard").collect())
    assert set(shard) <= set(range(4))
    clash = df.withColumns({"_tie": F.lit(1), "_n": F.lit(2), "shard": F.lit("own"), "row": F.lit(3), "draw": F.lit(4)})
    mixed = mixing.mixed_rows(clash, block_words=50, shards=4).collect()
    assert {(r._tie, r._n, r.shard, r.row, r.draw) for r in mixed} == {(1, 2, "own", 3, 4)}
    out = mixing.mixed_rows(df, block_words=50, shards=4)
    placed = [(r.shard, r.place) for r in mixing.mixed_rows(df.select("doc_id", "text", "source"), keep_plan=True, block_words=50, shards=4).coalesce(1).collect()]
    assert [s for s, _ in placed] == [s for s, g in itertools.groupby(s for s, _ in placed) for _ in g]
    assert all(a[1] <= b[1] for a, b in zip(placed, placed[1:]) if a[0] == b[0]) and len({s for s, _ in placed}) == 4
    assert out.columns == df.columns and sum(len(words(r["text"])) for r in out.collect()) == pytest.approx(sum(taken.values()), rel=0.1)
    assert mixing.mix(df.where("false"))[0].count() == 0


def test_simhash(spark, docs):
    rows, df = docs

    def fp(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted((str(r[0]), f"{p:016x}", str(low[g])) for r, p, g in zip(rows, prints, group))
    for size in (16384, 1):
        got = simhash_dedup.simhash_components(df, bucket_rows=size).collect()
        assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == want
    assert simhash_dedup.simhash_components(df.where("false")).count() == 0
    assert simhash_dedup.keep_one(df).columns == df.columns


def test_simhash_dense_cluster(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    parts = components.connected_components(simhash_dedup.link_edges(df, 4, bucket_rows=20))
    assert Counter(r["component"] for r in parts.collect()).most_common(1)[0][1] == sum((x ^ base).bit_count() <= 3 for x in prints)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(spark, docs):
    rows, df = docs
    ident = lambda r: 1 << 62 if r[0] is None else r[0]
    first = {}
    for r in sorted(rows, key=ident):
        w = words(r[1])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), ident(r))
    want = []
    for r in rows:
        w, gone = words(r[1]), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < ident(r):
                gone.update(range(k, k + 13))
        want.append((str(r[0]), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    got = substring_dedup.substring_dedup(df).collect()
    assert sorted((str(g.doc_id), g.n_words, g.n_removed, g.kept_sha256) for g in got) == sorted(want)
    assert substring_dedup.substring_dedup(df.where("false")).count() == 0


@pytest.mark.parametrize("hot_share", [8, 100_000])
def test_substring_index_is_incremental(spark, docs, tmp_path, hot_share):
    """Batch by batch through an index that is opened anew each time: the same as all documents at once. The second
    case salts every gram that comes often."""
    rows, df = docs
    shared = " ".join(f"s{i}" for i in range(30))
    more = [(200 + i, f"a{i} {shared} z{i}" if i % 2 else f"{shared} {shared} y{i}") for i in range(40)]
    df = df.select("doc_id", "text").where("doc_id is not null").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    whole = substring_dedup.substring_dedup(df, batches=1).collect()
    out = []
    for lo, hi in ((0, 30), (30, 70), (70, 70), (70, 210), (210, 300)):
        index = substring_dedup.SubstringIndex(spark, str(tmp_path / "index"), fanout=2, hot_share=hot_share)
        out += index.insert(df.where(f"doc_id >= {lo} and doc_id < {hi}")).collect()
    key = lambda g: (g.doc_id, g.n_words, g.n_removed, g.kept_sha256)
    assert sorted(map(key, out)) == sorted(map(key, whole))
    assert len(index.runs) == 1 and index.runs[0]["level"] == 2 and index.runs[0]["hot"] > 0


def test_substring_windows_meet_by_all_bits(spark, monkeypatch):
    """Windows that share the half of their digest by which they are dealt are still told apart; flushes and batches do not matter."""
    digest = substring_dedup.xxhash.xxh3_128_digest
    monkeypatch.setattr(substring_dedup.xxhash, "xxh3_128_digest", lambda w: b"12345678" + digest(w)[8:])
    a, b = ([f"{c}{i}" for i in range(20)] for c in "ab")
    w = [substring_dedup.zstandard.ZstdCompressor().compress(" ".join(x).encode()) for x in (a, b, b[2:])]
    rows = substring_dedup.pa.RecordBatch.from_arrays([[1, 2, 3], [0, 0, 0], w, [list(range(17))] * 3], ["doc", "tag", "z", "places"])
    for flush in (1, 1000):
        windows = list(substring_dedup._window_rows(iter([rows]), 13, 4, substring_dedup.FRESH, flush_rows=flush))
        table = substring_dedup.pa.Table.from_batches(windows).sort_by("h").combine_chunks().to_batches()
        got = [r for b in substring_dedup._repeats(iter(table)) for r in b.to_pylist()]
        assert sorted((r["doc"], r["at"]) for r in got) == [(3, i) for i in range(6)]


def test_suffix_lm(spark, docs):
    rows, df = docs
    held = lambda r: zlib.crc32(str("null" if r[0] is None else r[0]).encode()) % 10 == 0
    tokens = lambda r: (r[1] or "").encode().lower().split() + [None]
    count = Counter(t for r in rows if not held(r) for t in tokens(r))
    n, v = sum(count.values()), len(count)
    train = df.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 10 != 0)
    model = suffix_lm.train(train, head_words=10, next_words=5, min_gain=1.0, min_count=2, least=0.1, every=1, discount=0.3)
    got = suffix_lm.score(df, model).collect()
    base = lambda r: sum(np.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r))
    want = sorted((str(r[0]), len(tokens(r)), sum(count[t] > 0 for t in tokens(r)), round(base(r), 6)) for r in rows)
    assert sorted((str(g.doc_id), g.n_tokens, g.n_known, round(g.base_score, 6)) for g in got) == want
    assert all(g.score < 0 and np.isfinite(g.score) and g.train_tokens == n for g in got)
    # probabilities of all next symbols add up to one in every state of either kind; so do those of all bytes in every node
    kinds = sorted({w for r in rows for w in words(r[1].lower() if r[1] else "")}) + [b""]
    states = model.context.states(suffix_lm.suffix_codes(kinds, model.suffix))
    every = np.arange(len(model.context.root))
    assert (np.stack(states) >= 0).any() and model.phrases.count() > 0
    for i in range(len(kinds)):
        p = model.context.probability(states, np.full(len(every), i), every)
        assert p.sum() == pytest.approx(1) and (p > 0).all()
        for r in model.phrases.limit(3).collect():
            assert sum((r["counts"].get(w, 0) + r["rest"] * p[w]) / r["total"] for w in every.tolist()) == pytest.approx(1)
    # the other words' shares add up to one as well: their counts less the discount, and what that leaves
    assert model.other - model.discount * (model.distinct - model.end) + model.spread == pytest.approx(model.other)
    width = model.tree.logp.shape[1]
    seen = (10.0 ** model.tree.logp.astype(float)).sum(1) + (suffix_lm.SYMBOLS - width) * 10.0 ** model.tree.logp[:, 0].astype(float)
    assert np.allclose(seen, 1, atol=2e-2)
    empty = suffix_lm.score(df, suffix_lm.train(df.where("false"))).collect()
    assert all(g.n_known == 0 and np.isfinite(g.score) for g in empty)


def test_suffix_lm_all_phrases(spark):
    """By default, every phrase that comes twice with the same word after it is a state, and each place is scored by its phrase."""
    rng = random.Random(4)
    texts = [" ".join(f"u{i}x{j}" if j % 3 == 0 else rng.choice("abcdefgh") for j in range(60)) for i in range(12)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = suffix_lm.train(df, phrase_gain=-100.0)
    after = {}
    for t in texts:
        w = t.split() + [None]
        for i in range(3, len(w)):
            after.setdefault(tuple(w[i - 3 : i]), Counter())[w[i]] += 1
    want = sorted((c.total(), sorted(n for n in c.values() if n > 1)) for c in after.values())
    got = model.phrases.collect()
    assert sorted((r["total"] - model.phrase_smoothing, sorted(r["counts"].values())) for r in got) == want and len(want) > 600
    assert all(r["rest"] == r["total"] - sum(r["counts"].values()) for r in got)
    # a place's probability is its phrase's, and that of its bytes where no phrase stands before
    number = {**model.number, None: model.end}
    kinds = [w for w in model.number] + [b""]
    states = model.context.states(suffix_lm.suffix_codes(kinds, model.suffix))
    for g in suffix_lm.score(df, model, flush_rows=100).collect():
        w, total = [b"", *(x.encode() for x in texts[g.doc_id].split()), None], 0.0
        for i in range(1, len(w)):
            p = model.context.probability(states, np.array([kinds.index(w[i - 1])]), np.array([number[w[i]]]))[0]
            if i > 3:
                c = after[tuple(x.decode() for x in w[i - 3 : i])]
                own = {k: n for k, n in c.items() if n > 1}
                n = own.get(w[i] and w[i].decode(), 0)
                p = (n + (c.total() - sum(own.values()) + model.phrase_smoothing) * p) / (c.total() + model.phrase_smoothing)
            total += np.log10(p)
        assert g.score == pytest.approx(total, rel=1e-5)


def test_suffix_lm_rare_end(spark):
    """The end of a text counts as known and with its own count, also where many words are more frequent."""
    df = spark.createDataFrame([(1, "a a b b c c d d")], "doc_id long, text string")
    g = suffix_lm.score(df, suffix_lm.train(df, head_words=2, next_words=2)).first()
    assert g.n_known == g.n_tokens == 9
    assert g.base_score == pytest.approx(8 * np.log10(2.1 / 9.6) + np.log10(1.1 / 9.6))


def test_byte_bpe(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    rows, df = docs
    path, pattern = byte_bpe.default_vocabulary()
    ranks = byte_bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r[0]), own.encode_ordinary(r[1] or "")) for r in rows)
    for options in ({"table_words": 5, "long_word": 6}, {"table_words": 0}, {"sample_docs": 10}, {}):
        got = byte_bpe.encode(df, **options).collect()
        assert sorted((str(g.doc_id), list(g.ids)) for g in got) == want
    assert byte_bpe.encode(df.where("false")).count() == 0
    with pytest.raises(Exception, match="unknown id"):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()
    text = {str(r[0]) + hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows}
    assert {str(g.doc_id) + g.decoded_sha256 for g in got} == text
    back = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert sorted(bytes(b["bytes"]) for b in back) == sorted((r[1] or "").encode() for r in rows)
    rng = random.Random(2)
    some = ["".join(rng.choice("therinéß你*  ") for _ in range(rng.randint(1, 20))).encode() for _ in range(200)] + [b""]
    table = byte_bpe.encode_words(spark.createDataFrame([(bytearray(w),) for w in some], "word binary"), ranks)
    for r in table.collect():
        w = bytes(r["word"])
        assert list(r["ids"]) == (own._encode_single_piece(w) if w else []) == (list(byte_bpe.fold(w, ranks)) if w else [])
    long = ("abc*" * 4000).encode()
    assert list(byte_bpe.fold(long, ranks)) == list(byte_bpe.fold_long(long, ranks)) == own._encode_single_piece(long)


def test_pair_table():
    """The table of pairs, which the driver holds, has one pair for each piece at most, and folding by it is folding by ranks."""
    ranks = byte_bpe.read_ranks(byte_bpe.default_vocabulary()[0])
    rows = list(byte_bpe.pair_ranks(ranks))
    table, pieces, rng = dict(rows), list(ranks), random.Random(3)
    assert len(rows) == len(table) <= len(ranks)
    for _ in range(5000):
        word = b"".join(rng.choices(pieces, k=rng.randint(1, 4)))[rng.randint(0, 2) :]
        ids = [ranks[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1 and (low := min(found := [table.get(a * byte_bpe.SHIFT + b, byte_bpe.NEVER) for a, b in itertools.pairwise(ids)])) != byte_bpe.NEVER:
            i = found.index(low)
            ids[i : i + 2] = [low]
        assert ids == [ranks[x] for x in byte_bpe.fold_to(word, ranks, 1)]
        assert word in ranks or ids == list(byte_bpe.fold(word, ranks)) == list(byte_bpe.fold_long(word, ranks))


def test_rp_forest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).round(2)
    x[100:400] = x[100]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [1.0] * 3), (None, [1.0] * 8), (1005, [])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))
    got = rp_forest.nearest(df, df.where("vec_id % 100 = 0")).collect()
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(s == pytest.approx(d[v]) for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(want))
    assert hit >= 54
    # all leaves opened: the same as brute force, whatever the depth, batches and repeated rows
    repeated = df.unionByName(df.where("vec_id = 100")).unionByName(*[df.where("vec_id = 100")]).repartition(7)
    every = rp_forest.nearest(repeated, df.where("vec_id % 50 = 0"), trees=2, leaf_points=20, search_share=3.0).collect()
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        assert [g.vec_id for g in sorted((g for g in every if g.query_id == q), key=lambda g: g.rank)] == want
    few = df.where("vec_id < 3")
    assert rp_forest.nearest(few, few.where("vec_id = 0")).count() == 2
    assert rp_forest.nearest(df.where("false"), df).count() == 0


def test_patience():
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([9, 1, 2, 8], [7, 1, 2, 6, 5]) == [(1, 1), (2, 2)]
    assert line_dedup.patience([1, None, 2], [0, 1, None, 2]) == [(0, 1), (2, 3)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1, 1], [2, 2]) == []
    assert line_dedup.patience([5, 5, 1, 5], [5, 1, 5, 5]) == [(0, 0), (2, 1), (3, 3)]
    assert line_dedup.patience([8, 1, 8, 2], [3, 8, 4]) == [(0, 1)] and line_dedup.patience([8, 1, 8, 2], [3, 8, 4, 8]) == [(0, 1), (2, 3)]


def by_pairs(rows, rare_df):
    """The rule of line_dedup in plain Python, with lines as they are."""
    split = {(i, t): [x.rstrip(" \t\r\x0b\x0c") or None for x in (t or "").split("\n")] for i, t in rows}
    order = sorted(split, key=lambda n: (n[0] is None, n[0] or 0))
    first = {}
    for n in order:
        first.setdefault(tuple(split[n]), n)
    reps = [n for n in order if first[tuple(split[n])] == n]
    rank = {n: k for k, n in enumerate(reps)}
    holders, gone = {}, {n: set() for n in reps}
    for n in reps:
        for x in set(split[n]) - {None}:
            holders.setdefault(x, []).append(n)

    def meet(pairs):
        for a, b in set(pairs):
            gone[b].update(y for _, y in line_dedup.patience(split[a], split[b]))

    meet([(h[i], h[j]) for h in holders.values() if len(h) <= rare_df for j in range(len(h)) for i in range(j)] + [(h[0], b) for h in holders.values() if len(h) > rare_df for b in h[1:]])
    used = {x: {h[0]} for x, h in holders.items() if len(h) > rare_df}
    while True:
        left = {x: [n for n in holders[x] if n not in u and any(y == x and k not in gone[n] for k, y in enumerate(split[n]))] for x, u in used.items()}
        left = {x: h for x, h in left.items() if len(h) > 1}
        if not left:
            break
        meet([(h[0], b) for h in left.values() for b in h[1:]])
        for x, h in left.items():
            used[x].add(min(h, key=rank.get))
    out = []
    for n in [(i, t) for i, t in rows]:
        lines = (n[1] or "").split("\n")
        drop = gone[n] if n in gone else {k for k, x in enumerate(split[n]) if x is not None}
        out.append((str(n[0]), len(lines), len(drop), "\n".join(x for k, x in enumerate(lines) if k not in drop)))
    return sorted(out)


@pytest.mark.parametrize("rare_df", [4, 1, 100])
def test_line_dedup(spark, rare_df):
    shared = ["license line", "second shared", "third shared"]
    rows = [(i, "\n".join([f"own {i}", "", *shared, f"end {i}"])) for i in range(1, 12)]
    rows += [(20, rows[0][1]), (20, rows[0][1]), (21, None), (22, "\n \n"), (None, "own 1\nfresh"), (30, "third shared\nnew\nlicense line"), (31, "foo\r\nx"), (32, "foo \t\ny")]
    rows += [(40, "menu\na\nmenu\nb")] + [(40 + i, f"x{i}\nmenu\ny{i}") for i in range(1, 7)]
    rng = random.Random(11)
    lines = [f"line {k}" for k in range(12)]
    rows += [(100 + i, "\n".join(rng.choices(lines, k=rng.randint(1, 9)) + [f"u{rng.randrange(20)}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "seq": F.lit(2), "node": F.lit(3), "lines": F.lit(4)})
    got = line_dedup.line_dedup(df, rare_df=rare_df, block=3).collect()
    assert sorted((str(g.doc_id), g.n_lines, g.n_removed, g.kept_text) for g in got) == by_pairs(rows, rare_df)
    kept = {g.doc_id: g.kept_text for g in got}
    assert kept[2] == "own 2\n\nend 2" and kept[20] == "" and kept[22] == "\n \n" and kept[32] == "y" and kept[46] == "x6\ny6"
    assert line_dedup.line_dedup(df.where("false")).count() == 0


def test_line_hash_collisions(spark, monkeypatch):
    """Lines whose first hashes are equal are told apart by the second."""
    hash_ = line_dedup._hash
    monkeypatch.setattr(line_dedup, "_hash", lambda line, salt=None: F.length(line).cast("long") if salt is None else hash_(line, salt))
    df = spark.createDataFrame([(1, "abc\nxyz"), (2, "xyz\nqqq"), (3, "qqq\nlonger")], "doc_id long, text string")
    assert {g.doc_id: g.kept_text for g in line_dedup.line_dedup(df).collect()} == {1: "abc\nxyz", 2: "qqq", 3: "longer"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 1, 7, 3])
    u, t = rng.normal(size=16), rng.normal(size=(2, 2))
    got = crf.forward_backward(u, lengths, t)[0]
    pairs, at = np.zeros((2, 2)), 0
    for n in lengths:
        total, one = 0.0, np.zeros(n)
        two = np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(u[at + k] for k in range(n) if y[k]) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total, one = total + w, one + w * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += w
        assert np.allclose(got[at : at + n], one / total)
        pairs, at = pairs + two / total, at + n
    m, p, q = crf.forward_backward(u, lengths, t)
    assert np.allclose(crf.pair_marginals(u, lengths, t, p, q), pairs)
    many = rng.integers(1, 60, 200)
    v = rng.normal(size=many.sum())
    assert np.allclose(crf.forward_backward(v, many, t)[0][: many[0]], crf.forward_backward(v[: many[0]], many[:1], t)[0])


def labelled(spark, make, label):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        y = int(rng.random() < 0.3)
        rows.append((i, make(rng, y), "en", "s", 1))
        labels.append((i, y, y))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "plain", None, None, None), rows[0]]
    labels += [(0, None, None), (None, 1, 1), (5000, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("y", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    plain = [f"word{i}" for i in range(80)]
    make = lambda rng, y: " ".join(rng.choices(plain, k=30) + (["Moron!", "idiot"] if y else []) + rng.choices(plain, k=5))
    df, labels = labelled(spark, make, "toxic")
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model)
    rows = got.collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert all((r.score >= 0.3) == truth[r.doc_id] for r in rows if r.doc_id is not None and r.doc_id < 400)
    text = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        assert {text[r.doc_id][s.start : s.end].lower() for s in r.spans} <= {"moron", "idiot"}
    assert toxicity.score(df.where("false"), model).count() == 0
    blank = toxicity.train(df, labels.where("false"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, blank).collect())


def test_labelled_sample_passes_over_long_texts(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 2 else 10)) for i in range(50)] + [(4, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(4, 1)], "doc_id long, toxic int")
    got = training.labelled_sample(docs, labels, "toxic", 4, 2, 1000, 300)
    want = [i for i in range(0, 50, 2) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert got["_id"].tolist() == want and got.set_index("_id").loc[4].tolist() == ["x" * 10, 1]
    assert len(training.labelled_sample(docs, labels.where("false"), "toxic", 4, 2, 1000, 300)) == 0
    with pytest.raises(ValueError, match="no labelled text"):
        training.labelled_sample(docs, labels, "toxic", 4, 2, 1000, 5 - 5)


def test_quality(spark):
    good = lambda rng: " ".join(rng.choice(["the", "of", "house", "river", "stone", "walking"]) for _ in range(12)).capitalize() + "."
    junk = lambda rng: " ".join(rng.choice(["BUY!!", "NOW###", "$$$", "click$$$"]) for _ in range(12))
    make = lambda rng, y: "\n".join(good(rng) if y or rng.random() < 0.3 else junk(rng) for _ in range(6))
    df, labels = labelled(spark, make, "quality")
    model = quality.train(df, labels)
    rows = quality.score(df, model).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    right = [(r.score >= 0.5) == truth[r.doc_id] for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in rows) and len(rows) == df.count()
    kept = quality.good_rows(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.score >= 0.5 for r in rows)
    blank = quality.train(df, labels.where("false"))
    assert all(0 <= r.score <= 1 for r in quality.score(df, blank).collect())
    assert quality.score(df.where("false"), model).count() == 0


def test_pipeline(spark, tmp_path):
    """The stages against plain Python, but for the classifier, which is taken as it is."""
    import corpus_pipeline

    rng = random.Random(8)
    make = lambda rng, y: " ".join(rng.choices([f"word{i}" for i in range(200)], k=40)) if y else "!!! $$$ " * 20
    df, labels = labelled(spark, make, "quality")
    df.drop("y").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        kept.append(docs.collect())
    low = lambda t: (t or "").lower()
    best = {}
    for r in kept[0]:
        if low(r.text) not in best or (best[low(r.text)] or -1) < (r.doc_id or -1):
            best[low(r.text)] = r.doc_id
    assert sorted(map(str, best.values())) == sorted(str(r.doc_id) for r in kept[1])
    assert {r.doc_id for r in kept[2]} <= {r.doc_id for r in kept[1]}
    assert sum(len(words(r.text)) for r in kept[3]) == pytest.approx(sum(len(words(r.text)) for r in kept[2]), rel=0.02)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in out) == sorted((str(r.doc_id), bool(r.text)) for r in kept[3])
    assert rng is not None
