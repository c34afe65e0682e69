"""Operator 9, quality classifier: Bradley-Terry ranking of documents from preference pairs.

A pair says that one document is better than another. The model gives each document the score w.x
of its text statistics x and says that the first wins with probability sigmoid(w.(x1 - x2)); w
minimises the logistic loss on the differences. A document is kept if its score reaches the threshold,
a low quantile of the scores of all documents that are labelled good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _sample, _shared, _text

#: Labelled documents used for training at most, and preference pairs drawn from them for each of them.
TRAIN_ROWS, PAIRS_PER_ROW = 8000, 4
#: The threshold is this quantile of the scores of all labelled good documents, up to 1 / STEPS. The classes lie
#: apart: on held-out labels it rejects 0.3 % of the good documents and keeps as many of the bad.
QUANTILE, STEPS = 0.002, 64
SEED = 11

_b = np.arange(256)
_kind = np.full(256, 5)  # 0 lower case and non-ASCII, 1 upper case, 2 digit, 3 white space, 4 common marks, 5 other signs
_kind[((_b >= 97) & (_b <= 122)) | (_b >= 128)] = 0
_kind[(_b >= 65) & (_b <= 90)] = 1
_kind[(_b >= 48) & (_b <= 57)] = 2
_kind[_b <= 32] = 3
_kind[[ord(c) for c in ".,;:'\"-?!()"]] = 4
N_FEATURES = 9


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of N_FEATURES statistics of each text: shares of kinds of characters, of doubled marks, of repeated words; which texts are blank)."""
    out, blank = np.zeros((len(offsets) - 1, N_FEATURES)), np.ones(len(offsets) - 1, bool)
    for i, j in _text.groups(offsets):
        n = j - i
        if offsets[j] == offsets[i]:
            continue
        w = _text.Words(data, offsets[i : j + 1])
        size = np.diff(w.offsets)
        kinds, doubled = np.zeros((n, 6), np.int64), np.zeros(n, np.int64)
        for a, b in _text.windows(len(w.raw)):
            a_ = max(a - 1, 0)  # a doubled mark may begin in the window before
            kind = _kind[w.raw[a_:b]]
            at = np.repeat(np.arange(n), np.diff(np.clip(w.offsets, a_, b)))
            kinds += np.bincount(at[a - a_ :] * 6 + kind[a - a_ :], minlength=6 * n).reshape(n, 6)
            twice = (w.raw[a_ + 1 : b] == w.raw[a_ : b - 1]) & (kind[1:] >= 4) & (at[1:] == at[:-1])
            doubled += np.bincount(at[1:][twice], minlength=n)
        ink = np.maximum(size - kinds[:, 3], 1)
        words = np.maximum(w.count, 1)
        again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
        doc, _, _ = _text.unique_counts(w.doc, w.hash)
        blank[i:j] = size == kinds[:, 3]
        out[i:j] = np.sqrt(np.stack([
            kinds[:, 1] / ink, kinds[:, 2] / ink, kinds[:, 4] / ink, kinds[:, 5] / ink,
            doubled / ink,
            np.bincount(w.doc[again], minlength=n) / words,
            1 - np.minimum(np.bincount(doc, minlength=n) / words ** 0.8, 1),
            np.minimum(np.bincount(w.doc, weights=w.length, minlength=n) / words / 30, 1),
            (w.count == 0) * 1.0,
        ], axis=1))
    return out, blank


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return statistics(data, offsets)[0]


class Model:
    """score = w.clip((x - mean) / deviation); threshold: the least score that is kept."""

    def __init__(self, w: np.ndarray, mean: np.ndarray, deviation: np.ndarray, threshold: float = -np.inf):
        self.w, self.mean, self.deviation, self.threshold = w, mean, deviation, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        # summed row by row: a text's score doesn't depend on the batch that it comes in
        return (np.clip((x - self.mean) / self.deviation, -8, 8) * self.w).sum(axis=1)


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: float = 1e-6, steps: int = 60) -> np.ndarray:
    """The weights that minimise the mean logistic loss on x[better] - x[worse] plus a quadratic penalty (Newton's method)."""
    d = x[better] - x[worse]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        g = penalty * w - d.T @ (1 - p) / len(d)
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED) -> Model:
    """The weights, from pairs of at most `rows` labelled documents; no threshold yet. Without both a good and a bad one every score is 0."""
    sample = _sample.labelled_sample(docs, labels, "quality", rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.parts(batches):
            data, offsets, _ = _text.column_buffers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(features(data, offsets)), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = sorted(sample.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id bigint, label int, x array<double>").collect())
    y, x = np.array([r.label for r in got]), np.array([r.x for r in got]).reshape(-1, N_FEATURES)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = Model(np.zeros(N_FEATURES), x.mean(0), np.maximum(x.std(0), 1e-3))
    rng = np.random.default_rng(seed)
    pairs = PAIRS_PER_ROW * len(got)
    z = np.clip((x - model.mean) / model.deviation, -8, 8)
    model.w = fit_pairs(z, rng.choice(good, pairs), rng.choice(bad, pairs))
    return model


def threshold(scores: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> float:
    """The greatest multiple of 1 / STEPS that at most this share of the documents labelled good lie under; scores: (doc_id, score).

    Scores are counted by such steps, of which there are some thousands at most, so it doesn't depend on
    partitions and no task sorts. A document counts once, with its greatest label and least score.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality > 0").select("doc_id")
    mine = scores.where("score is not null").join(good, "doc_id").groupBy("doc_id").agg(F.min("score").alias("score"))
    counts = sorted(mine.groupBy(F.floor(F.col("score") * STEPS).alias("step")).count().collect())
    allowed = int(quantile * sum(n for _, n in counts))
    for step, n in counts:
        allowed -= n
        if allowed < 0:
            return step / STEPS
    return -np.inf


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, quantile: float = QUANTILE, seed: int = SEED) -> Model:
    """Weights and threshold, for which all documents are scored once. Without both a good and a bad document every score is 0 and all are kept."""
    model = train(docs, labels, rows, seed)
    if model.w.any():
        model.threshold = threshold(scores(docs, model), labels, quantile)
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row for each row of docs; null for null and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.parts(batches):
            s, ok = _scored(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, mask=~ok)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def kept(scored: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, keep) from (doc_id, score)."""
    return scored.select("doc_id", "score", F.coalesce(F.col("score") >= F.lit(float(model.threshold)), F.lit(False)).alias("keep"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, keep), one row for each row of docs.

    Null and blank texts have no score (null) and aren't kept. Null ids stay null, repeated rows get
    equal rows, texts of any length count whole, other columns are not looked at; empty in, empty out.
    """
    return kept(scores(docs, model), model)


def ranked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What `score` gives with the model of `fit`, but documents are scored only once."""
    model = train(docs, labels)
    found = _shared.materialize(scores(docs, model), "scores")
    if model.w.any():
        model.threshold = threshold(found, labels)
    return kept(found, model)


def _scored(text: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The scores, and which texts have one."""
    data, offsets, null = _text.column_buffers(text)
    x, blank = statistics(data, offsets)
    return model.score(x), ~null & ~blank


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that `score` keeps, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.parts(batches):
            s, ok = _scored(b.column(at), model)
            yield b.filter(pa.array(ok & (s >= model.threshold)))

    return docs.mapInArrow(run, docs.schema)
