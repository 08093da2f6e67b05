"""Quality by a linear-chain CRF that labels every line good or bad.

A line's features are measures of its form (kinds of characters, word lengths, repeats, share of
frequent words), cut at training quantiles, together with those of the lines before and after it.
Learning: a bounded sample of labelled documents (`max_docs`, whole texts of `max_chars` together). Lines of good
documents are good; those of bad documents are bad where a first logistic model finds them so, or all
of them where it finds none. Marginals of all lines of a whole text, weighted by line length, give the
document's mean goodness, and a logistic function of it the score.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import crc_mod, release, slices
from quern.llm.crf import CRF, fit_logistic, forward_backward, logistic
from quern.llm.training import labelled_sample

UPPER, LOWER, DIGIT, PUNCT = (x.encode() for x in (string.ascii_uppercase, string.ascii_lowercase, string.digits, string.punctuation))
SENTENCE = b".,;:?'\"()-"
BINS = 6
MEASURES = 16


def lines_of(text: str | None) -> list[bytes]:
    """The lines of a text that are not blank."""
    return [x for x in (text or "").encode("utf-8", "replace").split(b"\n") if x and not x.isspace()]


def measure(line: bytes, common: frozenset[bytes], seen: bool) -> tuple[float, ...]:
    n = len(line)
    words = line.split()
    k = len(words)
    punct = n - len(line.translate(None, PUNCT))
    plain = n - len(line.translate(None, SENTENCE))
    upper = n - len(line.translate(None, UPPER))
    lower = n - len(line.translate(None, LOWER))
    digit = n - len(line.translate(None, DIGIT))
    low = [w.lower().rstrip(PUNCT) for w in words]
    kinds = len(set(words))
    lengths = list(map(len, words))
    mean = sum(lengths) / k
    return (
        math.log(n),
        upper / n,
        lower / n,
        digit / n,
        (punct - plain) / n,
        plain / n,
        1 - (upper + lower + digit + punct + k) / n,
        mean,
        max(lengths),
        kinds / k,
        sum(map(eq, words, words[1:])) / k,
        sum(map(common.__contains__, low)) / k,
        line.count(b"|") / k,
        float(line.rstrip()[-1:] in (b".", b"!", b"?")),
        float(seen),
        upper / max(1, upper + lower),
    )


def measures(docs: list[list[bytes]], common: frozenset[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of every line, line counts, line lengths in bytes)."""
    rows, weight = [], []
    for lines in docs:
        before: set[bytes] = set()
        for x in lines:
            rows.append(measure(x, common, x in before))
            weight.append(len(x))
            before.add(x)
    return np.array(rows).reshape(-1, MEASURES), np.fromiter(map(len, docs), np.int64, len(docs)), np.array(weight, float)


@dataclass
class Model:
    common: frozenset[bytes]
    cuts: np.ndarray
    crf: CRF
    doc: np.ndarray

    def features(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the bins of a line's own, previous and next line's measures; -1 at the ends; the last is the bias."""
        block = MEASURES * BINS
        own = np.stack([np.searchsorted(self.cuts[j], x[:, j], "right") + j * BINS for j in range(MEASURES)], 1) if len(x) else np.zeros((0, MEASURES), np.int64)
        out = np.full((len(x), 3 * MEASURES + 1), -1, np.int16)
        out[:, -1] = 3 * block
        out[:, :MEASURES] = own
        inner = np.ones(len(x), bool)
        inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        at = np.flatnonzero(inner)
        out[at, MEASURES : 2 * MEASURES] = own[at - 1] + block
        out[at - 1, 2 * MEASURES : 3 * MEASURES] = own[at] + 2 * block
        return out

    def doc_features(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, lengths, weight = measures(docs, self.common)
        good = forward_backward(self.crf.scores(self.features(x, lengths)), lengths, self.crf.trans)[0] if len(x) else np.zeros(0)
        mean = np.full(len(docs), 0.5)
        full = np.flatnonzero(lengths)
        if full.size:
            starts = (np.cumsum(lengths) - lengths)[full]
            mean[full] = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        return np.column_stack([np.log((mean + 1e-3) / (1 - mean + 1e-3)), mean]), good, lengths


def train(docs: DataFrame, labels: DataFrame, *, mod: int = 3, held: int = 1, max_docs: int = 4000, max_chars: int = 40_000_000, common_words: int = 400) -> Model:
    sample = labelled_sample(docs, labels, "quality", mod, held, max_docs, max_chars)
    texts = [lines_of(x) for x in sample["text"]]
    y = sample["y"].to_numpy(np.int64, copy=True)
    counts = Counter(w.lower().rstrip(PUNCT) for d, label in zip(texts, y) if label for w in {w for x in d for w in x.split()})
    common = frozenset(w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:common_words])
    x, lengths, _ = measures(texts, common)
    size = 3 * MEASURES * BINS + 1
    cuts = np.quantile(x, [0.02, 0.15, 0.5, 0.85, 0.98], axis=0).T.copy() if len(x) else np.zeros((MEASURES, BINS - 1))
    model = Model(common, cuts, CRF(size, np.zeros(size), np.zeros((2, 2))), np.zeros(3))
    if not len(x):
        return model
    features = model.features(x, lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    truth = y[owner]
    if 0 < truth.sum() < len(truth):
        # without neighbours in a sequence the field is a logistic model of single lines
        own = features[:, [*range(MEASURES), -1]]
        single = CRF(size).fit(own, truth, np.ones(len(truth), np.int64), epochs=80, rate=0.2, l2=1e-5)
        good = np.where(truth == 0, single.scores(own) > 0, True)
        all_good = np.bincount(owner, ~good, len(texts)) == 0
        truth = np.where((truth == 0) & all_good[owner], 0, good).astype(np.int64)
    model.crf = CRF(size).fit(features, truth, lengths, epochs=80, rate=0.2, l2=1e-5)
    model.doc = fit_logistic(model.doc_features(texts)[0], y.astype(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_lines, bad_lines (numbers, among the lines that are not blank, of those more likely bad).

    Null texts are empty; a text without lines has a score (that of no evidence) and no bad lines. A
    null doc_id is returned as null, a repeated row again. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                x, good, lengths = m.doc_features([lines_of(t) for t in part.column("text").to_pylist()])
                ends = np.cumsum(lengths)
                bad = [np.flatnonzero(good[e - n : e] < 0.5).tolist() for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(logistic(x, m.doc)), pa.array(lengths), pa.array(bad, pa.list_(pa.int64()))], ["doc_id", "score", "n_lines", "bad_lines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_lines long, bad_lines array<long>")


def good_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns: one pass, no join."""
    model = train(docs, labels, **options)
    release(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                x, _, _ = m.doc_features([lines_of(t) for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(logistic(x, m.doc) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "bad_lines")
