"""Toxicity by a linear-chain CRF over words.

Learning: a bounded sample of labelled documents (`max_docs`, whole texts of `max_chars` together). A word form is
taken for toxic where its documents' labels say so beyond chance; its tokens in toxic documents are
the labelled tokens, all others are clean. Features are the word form and its neighbours' forms. The
model is a table with at most `vocabulary` forms, so its broadcast is bounded. A logistic function of
the marginals (largest, sum, length) turns them into a document score.

Scoring: every token of the whole text gets its forward-backward marginal; tokens of at least
`threshold` are the toxic spans, with character offsets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import crc_mod, slices
from quern.llm.crf import CRF, fit_logistic, forward_backward, logistic
from quern.llm.training import labelled_sample

TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text or "")]


@dataclass
class Model:
    vocab: dict[str, int]
    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    trans: np.ndarray
    bias: float
    doc: np.ndarray

    def marginals(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        n = int(lengths.sum())
        ids = np.fromiter((i for d in docs for i in map(self.vocab.get, d, repeat(0))), np.int64, n)
        u = self.here[ids] + self.bias
        if n > 1:
            inner = np.ones(n, bool)
            inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
            at = np.flatnonzero(inner)
            u[at] += self.before[ids[at - 1]]
            u[at - 1] += self.after[ids[at]]
        return forward_backward(u, lengths, self.trans)[0], lengths

    def doc_scores(self, marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return logistic(doc_features(marginal, lengths), self.doc)


def doc_features(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Largest marginal as log odds, log of the sum, log length; a document without tokens has none of either."""
    top, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if full.size:
        starts = (np.cumsum(lengths) - lengths)[full]
        top[full] = np.maximum.reduceat(marginal, starts)
        total[full] = np.add.reduceat(marginal, starts)
    odds = np.log((top + 1e-4) / (1 - top + 1e-4))
    return np.column_stack([odds, np.log(total + 0.01), np.log1p(lengths)])


def toxic_forms(docs: list[list[str]], y: np.ndarray, evidence: float, share: float) -> set[str]:
    """Forms whose documents are labelled toxic too often for chance (log likelihood ratio) and mostly."""
    in_toxic: Counter[str] = Counter()
    in_all: Counter[str] = Counter()
    for d, label in zip(docs, y):
        forms = set(d)
        in_all.update(forms)
        if label:
            in_toxic.update(forms)
    base = (y.sum() + 0.5) / (len(y) + 1)
    out = set()
    for form, a in in_toxic.items():
        p = a / in_all[form]
        if p > share:
            b = in_all[form] - a
            if a * np.log(p / base) + (b * np.log((1 - p) / (1 - base)) if b else 0) >= evidence:
                out.add(form)
    return out


def train(docs: DataFrame, labels: DataFrame, *, mod: int = 4, held: int = 2, max_docs: int = 4000, max_chars: int = 40_000_000, vocabulary: int = 100_000, evidence: float = 8.0, share: float = 0.6) -> Model:
    sample = labelled_sample(docs, labels, "toxic", mod, held, max_docs, max_chars)
    texts = [tokens(x) for x in sample["text"]]
    y = sample["y"].to_numpy(np.int64, copy=True)
    bad = toxic_forms(texts, y, evidence, share)
    counts = Counter(w for d in texts for w in d)
    forms = sorted(bad) + [w for w, n in counts.most_common(vocabulary) if n >= 5 and w not in bad][: vocabulary - len(bad)]
    vocab = {w: i + 1 for i, w in enumerate(forms)}
    size = len(vocab) + 1
    # Learning needs every toxic document, and of the others as many.
    rng = np.random.default_rng(0)
    clean = np.flatnonzero(y == 0)
    use = np.sort(np.concatenate([np.flatnonzero(y), rng.permutation(clean)[: max(200, 2 * int(y.sum()))]]))
    lengths = np.array([len(texts[i]) for i in use], np.int64)
    ids = np.array([vocab.get(w, 0) for i in use for w in texts[i]], np.int64)
    truth = np.array([int(y[i] and w in bad) for i in use for w in texts[i]], np.int64)
    features = np.full((len(ids), 4), 3 * size)
    features[:, 0] = ids
    inner = np.ones(len(ids), bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inner)
    features[:, 1:3] = -1
    features[at, 1] = size + ids[at - 1]
    features[at - 1, 2] = 2 * size + ids[at]
    crf = CRF(3 * size + 1).fit(features, truth, lengths, epochs=40, rate=0.3, l2=1e-6) if len(ids) else CRF(3 * size + 1, np.zeros(3 * size + 1), np.zeros((2, 2)))
    w = crf.weights
    model = Model(vocab, w[:size], w[size : 2 * size], w[2 * size : 3 * size], crf.trans, float(w[-1]), np.zeros(4))
    model.doc = fit_logistic(doc_features(*model.marginals(texts)), y) if len(y) else np.zeros(4)
    return model


RESULT = "doc_id long, score double, n_tokens long, spans array<struct<start:long,end:long,score:double>>"


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, n_tokens, spans: character offsets and marginals of the toxic tokens, end exclusive.

    Null texts are empty; an empty text has a score (that of no evidence), and no spans. A null doc_id
    is returned as null, a repeated row again. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                marginal, lengths = m.marginals([tokens(x) for x in texts])
                starts = np.cumsum(lengths) - lengths
                spans: list[list[dict]] = [[] for _ in texts]
                hits = np.flatnonzero(marginal >= threshold)
                owner = np.searchsorted(starts + lengths, hits, "right")
                for i in np.unique(owner).tolist():
                    places = [x.span() for x in TOKEN.finditer(texts[i])]
                    spans[i] = [{"start": places[k][0], "end": places[k][1], "score": float(marginal[starts[i] + k])} for k in (hits[owner == i] - starts[i]).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(m.doc_scores(marginal, lengths)), pa.array(lengths), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                    ["doc_id", "score", "n_tokens", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_tokens", "spans")
