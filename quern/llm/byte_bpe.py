"""Byte-level BPE encoding and decoding by ranks in a vocabulary file.

1. The distinct words of a bounded number of documents (`sample_docs`) are counted.
2. `encode_words` encodes words: Spark higher-order functions fold the ranked merges over the array of the word's
   byte pieces; each step looks the ranks of neighbouring pairs up in a literal rank map and joins the lowest.
   Lookup in a map literal scans it, so the literal is an array of small maps. The folding takes the square of a
   word's length, so it gets words of `long_word` bytes at most.
3. The `table_words` most frequent words that come more than once are encoded so, once each, and broadcast as flat
   arrays. All other words are folded in the task by the same merges, distinct words of a slice of texts once: to
   encode all of the corpus' words elsewhere and to join them back does not fit the limits (the README has figures).
   Which words the table holds never changes a result.
4. Decoding looks up the piece of each id in a literal array and concatenates the pieces, in Spark.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.arrays import let
from quern.llm._common import partitions, release, slices, staged, trim

NEVER = (1 << 31) - 1


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 piece, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public multilingual vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def fold(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word: join the leftmost pair of lowest rank until no pair has one."""
    if word in ranks:
        return (ranks[word],)
    if len(word) > 100:
        return fold_long(word, ranks)
    return tuple([ranks[p] for p in fold_to(word, ranks, 1)])


def fold_to(word: bytes, ranks: dict[bytes, int], least: int) -> list[bytes]:
    """The pieces of a word once no pair has a rank, or `least` are left."""
    n, get = len(word), ranks.get
    parts = [word[i : i + 1] for i in range(n)]
    pairs = [get(word[i : i + 2], NEVER) for i in range(n - 1)]
    while len(parts) > least and (lowest := min(pairs)) != NEVER:
        i = pairs.index(lowest)
        parts[i] += parts[i + 1]
        del parts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
    return parts


def fold_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap over linked pieces, whose cost grows little faster than the word."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0 once it has joined its left neighbour
    left = list(range(-1, n - 1))
    queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, a, b, c = heapq.heappop(queue)
        if end[a] != b or b >= n or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            left[c] = a
            if (r := ranks.get(word[a : end[c]])) is not None:
                heapq.heappush(queue, (r, a, c, end[c]))
        if (p := left[a]) >= 0 and (r := ranks.get(word[p:c])) is not None:
            heapq.heappush(queue, (r, p, a, c))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return tuple(out)


SHIFT = 1 << 20  # more than there are ids; a pair's key is the left id times this, plus the right id


def pair_ranks(ranks: dict[bytes, int]) -> Iterator[tuple[int, int]]:
    """(key, rank) of the pairs of ids that folding can join: one for each piece. Until a piece is joined, no merge crosses its
    ends, so its bytes go the way that they go by themselves, whatever stands beside them; of its other splits none comes up."""
    for piece, rank in ranks.items():
        if len(piece) > 1 and len(parts := fold_to(piece, ranks, 2)) == 2:
            yield ranks[parts[0]] * SHIFT + ranks[parts[1]], rank


def pair_literal(ranks: dict[bytes, int], slots: int) -> Column:
    """The rank map over pairs of ids, as a literal array of small maps: a pair is in the map of its key modulo slots."""
    rows = sorted((key % slots, key, rank) for key, rank in pair_ranks(ranks))
    maps = [""] * slots
    for slot, group in groupby(rows, key=itemgetter(0)):
        maps[slot] = ",".join([f'"{key}":{rank}' for _, key, rank in group])
    return F.from_json(F.lit("[{" + "},{".join(maps) + "}]"), "array<map<string,int>>")


def encode_words(words: DataFrame, ranks: dict[bytes, int], slots: int = 16_381) -> DataFrame:
    """words(word binary, ...) -> with ids array<int>: the merges folded by higher-order functions.

    The state is the array of a word's pieces by id, its bytes at first; a step joins the leftmost pair of lowest rank.
    A null word has null ids, an empty one none.
    """
    single = F.array(*[F.lit(ranks[bytes([i])]) for i in range(256)])

    def ids(text: Column, table: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            key = left.cast("long") * SHIFT + right
            return F.coalesce(F.try_element_at(F.get(table, (key % slots).cast("int")), key.cast("string")), F.lit(NEVER))

        def ranks_of(parts: Column) -> Column:
            return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda right, i: rank(F.get(parts, i), right))

        def step(parts: Column, _) -> Column:
            def joined(found: Column) -> Column:
                def at(lowest: Column) -> Column:
                    i = F.array_position(found, lowest).cast("int")
                    whole = F.concat(F.slice(parts, F.lit(1), i - 1), F.array(lowest), F.slice(parts, i + 2, F.greatest(F.lit(0), F.size(parts) - i - 1)))
                    return F.when(lowest == NEVER, parts).otherwise(whole)

                return let(F.array_min(found), at)

            return F.when(F.size(parts) < 2, parts).otherwise(let(ranks_of(parts), joined))

        start = F.transform(F.regexp_extract_all(text, F.lit(".."), F.lit(0)), lambda x: F.get(single, F.conv(x, 16, 10).cast("int")))
        folded = let(start, lambda parts: F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), parts, step))
        return F.when(text == "", F.array().cast("array<int>")).otherwise(folded)

    # the table stands in the plan once: plans with it are long to print
    found = let(pair_literal(ranks, slots), lambda table: ids(F.hex("word"), table))
    return words.withColumn("ids", F.when(F.col("word").isNotNull(), found))


def _count(batches: Iterator[pa.RecordBatch], pattern: str, flush_words: int = 300_000) -> Iterator[pa.RecordBatch]:
    trim()
    find, counts = regex.compile(pattern).findall, Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            for text in part.column("text").to_pylist():
                counts.update(find(text or ""))
            if len(counts) >= flush_words:
                yield flush()
    if counts:
        yield flush()


@dataclass
class WordTable:
    """Words and their ids end to end, in the order of the words' hashes; made once on the driver, of bounded size."""

    hashes: np.ndarray
    words: bytes
    word_ends: np.ndarray
    ids: bytes
    id_ends: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, piece: int = 10_000) -> WordTable:
        """table(word, ids); of words with one hash, one is in the table."""
        words, ids = table.column("word").combine_chunks(), table.column("ids").combine_chunks()
        hashes = [[xxhash.xxh3_64_intdigest(w) for w in words.slice(i, piece).to_pylist()] for i in range(0, len(words), piece)]
        hashes, order = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.array(h, np.uint64) for h in hashes)]), return_index=True)
        words, ids = words.take(pa.array(order)), ids.take(pa.array(order))
        ends = lambda x: np.concatenate(([0], np.cumsum(x.to_numpy(zero_copy_only=False)))).astype(np.int64)
        joined = words.buffers()[2].to_pybytes()[: ends(pc.binary_length(words))[-1]] if len(words) else b""
        return cls(hashes, joined, ends(pc.binary_length(words)), ids.flatten().to_numpy().astype("<i4").tobytes(), ends(pc.list_value_length(ids)))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, four bytes each; None for words that are not in the table. Hashes tell where to look, the
        words' bytes decide."""
        if not len(self.hashes):
            return [None] * len(words)
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        starts, stops, lo, hi = (x.tolist() for x in (self.word_ends[at], self.word_ends[at + 1], 4 * self.id_ends[at], 4 * self.id_ends[at + 1]))
        known, ids = self.words, self.ids
        return [ids[c:d] if known[a:b] == w else None for w, a, b, c, d in zip(words, starts, stops, lo, hi)]


class Encoder:
    """Encodes texts by a table; remembers up to `remembered` other words. Made once in each task."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], table: WordTable, remembered: int = 200_000):
        self.split, self.ranks, self.table, self.remembered = regex.compile(pattern).findall, ranks, table, remembered
        self.seen: dict[bytes, bytes] = {}

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes each."""
        out, seen = self.table.find(words), self.seen
        for i, w in enumerate(words):
            if out[i] is None:
                if (x := seen.get(w)) is None:
                    x = seen[w] = array("i", fold(w, self.ranks)).tobytes()
                out[i] = x
        if len(seen) > self.remembered:
            self.seen = {}
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, how many each text has). Distinct words are looked up or folded once."""
        words = [self.split(x or "") for x in texts]
        kinds = list(set().union(*words))
        place = dict(zip(kinds, range(len(kinds))))
        own = self.ids_of([w.encode() for w in kinds])
        sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        flat, starts = np.frombuffer(b"".join(own), "<i4"), np.cumsum(sizes) - sizes
        which = np.fromiter(map(place.__getitem__, chain.from_iterable(words)), np.int64)
        n = sizes[which]
        ids = flat[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, words)])]
        return ids, np.diff(ends)


def _encode(batches: Iterator[pa.RecordBatch], pattern: str, ranks: dict[bytes, int], table: WordTable) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id, ids, their number and digest."""
    trim()  # workers are used again and hold what tasks before have left
    encoder, name = Encoder(pattern, ranks, table), list(map(str, range(max(ranks.values()) + 1))).__getitem__
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            ids, n = encoder.encode(part.column("text").to_pylist())
            ends = np.cumsum(n)
            shas = [hashlib.sha256(",".join(map(name, ids[b - k : b].tolist())).encode()).hexdigest() for k, b in zip(n.tolist(), ends.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(n), pa.array(shas, pa.string())], ["doc_id", "ids", "n_tokens", "ids_sha256"])
        trim()  # two workers share an executor's memory with its JVM


def word_table(docs: DataFrame, ranks: dict[bytes, int], pattern: str, sample_docs: int, table_words: int, long_word: int) -> WordTable:
    """The most frequent words of about sample_docs documents that come more than once, encoded by higher-order functions."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col("text").cast("string").alias("text"))
    found = some.mapInArrow(partial(_count, pattern=pattern), "word binary, n long")
    counted = found.where(F.octet_length("word") <= long_word).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    words = staged(counted.orderBy(F.desc("n"), "word").limit(table_words).select("word"), "bpe-words")
    release(docs.sparkSession)  # before the pair table comes
    return WordTable.of(staged(encode_words(words.repartition(partitions(docs.sparkSession)), ranks), "bpe-table").toArrow())


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, ids: bool = True, sample_docs: int = 20_000, table_words: int = 200_000, long_word: int = 64) -> DataFrame:
    """doc_id, ids array<int> (if asked for), n_tokens, ids_sha256, decoded_sha256: every whole text, encoded and decoded again.

    A null text is an empty one, with no ids. A null doc_id is returned as null, a repeated row again;
    other columns are ignored. Special tokens in a text are ordinary text. The vocabulary file is read on the driver only.
    """
    default = default_vocabulary() if path is None or pattern is None else (path, pattern)
    ranks, pattern = read_ranks(path or default[0]), pattern or default[1]
    release(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((pattern, ranks, word_table(docs, ranks, pattern, sample_docs, table_words, long_word)))
    release(docs.sparkSession)  # the pair table's plans are done
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = rows.mapInArrow(lambda b: _encode(b, *held.value), "doc_id long, ids array<int>, n_tokens long, ids_sha256 string")
    return done.select("doc_id", *["ids"] * ids, "n_tokens", "ids_sha256", F.sha2(decoded_bytes(F.col("ids"), ranks), 256).alias("decoded_sha256"))


def decoded_bytes(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The pieces of the ids from a literal array, one after the other. Null ids give null, unknown ids an error."""
    pieces = {i: p.hex() for p, i in ranks.items()}
    table = F.from_json(F.lit(json.dumps([pieces.get(i) for i in range(max(pieces) + 1)])), "array<string>")
    known = ids.isNull() | (F.size(ids) == 0) | ((F.array_min(ids) >= 0) & (F.array_max(ids) <= max(pieces)))
    if len(pieces) <= max(pieces):  # ids with gaps
        known = known & ~F.exists(ids, lambda i: i.isin(*[i for i in range(max(pieces)) if i not in pieces]))
    joined = let(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))
    return F.when(known, joined).otherwise(F.raise_error(F.lit("unknown id")).cast("binary"))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens(doc_id, ids) -> doc_id, bytes."""
    return tokens.select("doc_id", decoded_bytes(F.col("ids"), read_ranks(path or default_vocabulary()[0])).alias("bytes"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
