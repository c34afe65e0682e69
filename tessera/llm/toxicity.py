"""Operator 6, toxicity: cumulative-link ordinal regression on the words of a text.

A text's features are the presence of its (hashed) words; s is the sum of their weights. The chance of a grade
above j is sigmoid(s - threshold[j]), with the same weights for every threshold. Training minimises
the negative log likelihood of the grades with an L1 penalty by proximal AdaGrad; the penalty is the
one under which folds left out are likeliest, so it is the labels that decide how many words count.
Words come into question by the size of their effect alone, whatever the number of labels: they are LIFT times
as frequent (in documents) in one class as in the other.

Where the labels only tell toxic (1) from clean (0), grades come from them so: 0 is clean; toxic
documents get 1 to 3 by how many distinct marker words they hold, cut at the terciles of the toxic
documents that hold any. Marker words are those at least LIFT times as frequent (in documents) among
toxic as among clean documents of the sample. Toxic documents without one get grade 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _sample, _text

HASH_BITS = 20
#: Labelled documents used for training at most. Words in fewer of them than MIN_DOCS get no weight.
TRAIN_ROWS, MIN_DOCS, LIFT = 8000, 3, 8.0
#: A text is toxic if its chance of a grade above 0 is at least this (a document that holds a single one of
#: the telling words lies just above it).
FLAG_AT = 0.15
#: Penalties to choose from, folds and steps to choose by, steps of the last fit.
PENALTIES, FOLDS, TRIAL_STEPS, STEPS = (3e-3, 1e-3, 3e-4, 1e-4, 3e-5), 4, 200, 1000
SEED = 3


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed word) of each text's distinct words; for one group of texts."""
    w = _text.Words(data, offsets)
    key = np.unique((w.doc.astype(np.int64) << HASH_BITS) | (w.hash >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """weights of hashed words, thresholds in ascending order."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, s: np.ndarray) -> np.ndarray:
        """The chance that the grade is above 0, 1, ..., a column each."""
        return np.where(np.isinf(self.thresholds), 0.0, _sigmoid(s[:, None] - self.thresholds))


def fit_ordinal(row: np.ndarray, col: np.ndarray, y: np.ndarray, columns: int, grades: int, penalty: float = 1e-6, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for the presence matrix with ones at (row, col) and the grades y."""
    n = len(y)
    share = np.array([(np.sum(y > j) + 0.5) / (n + 1) for j in range(grades - 1)])
    t = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(grades - 1))
    w, gw, gt = np.zeros(columns), np.full(columns, 1e-8), np.full(grades - 1, 1e-8)
    low, high = np.maximum(y - 1, 0), np.minimum(y, grades - 2)
    for _ in range(steps):
        s = np.bincount(row, weights=w[col], minlength=n)
        a = np.where(y < grades - 1, _sigmoid(t[high] - s), 1.0)  # chance of at most y
        b = np.where(y > 0, _sigmoid(t[low] - s), 0.0)  # of less than y
        p = np.maximum(a - b, 1e-12)
        g = np.bincount(col, weights=(1 - a - b)[row] / n, minlength=columns)
        dt = (np.bincount(low, weights=b * (1 - b) / p, minlength=grades - 1) - np.bincount(high, weights=a * (1 - a) / p, minlength=grades - 1)) / n
        gw += g * g
        gt += dt * dt
        step = 0.3 / np.sqrt(gw)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        t = np.maximum.accumulate(t - 0.3 / np.sqrt(gt) * dt + 1e-6 * np.arange(grades - 1))
    return w, t


def grade(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, columns: int) -> np.ndarray:
    """Grades 0 to 3 from labels 0 and 1, as the module says."""
    bad = toxic > 0
    n_bad, n_good = max(bad.sum(), 1), max((~bad).sum(), 1)
    df_bad = np.bincount(col[bad[row]], minlength=columns)
    df_good = np.bincount(col[~bad[row]], minlength=columns)
    marker = (df_bad >= 3) & (df_bad / n_bad >= LIFT * (df_good + 1) / n_good)
    held = np.bincount(row, weights=marker[col], minlength=len(toxic))
    some = held[bad & (held > 0)]
    cuts = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else np.array([np.inf, np.inf])
    return np.where(bad, 1 + (held[:, None] > cuts).sum(1), 0)


def telling(row: np.ndarray, col: np.ndarray, bad: np.ndarray, columns: int) -> np.ndarray:
    """Which words (columns) come into question, as MIN_DOCS and LIFT have it: by document frequencies with half a document added to each class."""
    n1, n0 = bad.sum(), (~bad).sum()
    d1, d0 = np.bincount(col[bad[row]], minlength=columns), np.bincount(col[~bad[row]], minlength=columns)
    effect = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    return (d1 + d0 >= min(MIN_DOCS, max(2, (n1 + n0) // 20))) & (np.abs(effect) >= np.log(LIFT))


def loss(w: np.ndarray, t: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray) -> float:
    """The mean negative log likelihood of the grades y."""
    s, last = np.bincount(row, weights=w[col], minlength=len(y)), len(t)
    a = np.where(y < last, _sigmoid(t[np.minimum(y, last - 1)] - s), 1.0)
    b = np.where(y > 0, _sigmoid(t[np.maximum(y - 1, 0)] - s), 0.0)
    return float(-np.log(np.maximum(a - b, 1e-12)).mean())


def chosen_penalty(row: np.ndarray, col: np.ndarray, y: np.ndarray, columns: int, grades: int) -> float:
    """The penalty of PENALTIES with the least loss on folds left out; words are chosen anew without each fold."""
    fold = np.arange(len(y)) % FOLDS
    total = np.zeros(len(PENALTIES))
    for f in range(FOLDS):
        parts = []
        for mine in (fold != f, fold == f):
            has = mine[row]
            parts.append(((np.cumsum(mine) - 1)[row[has]], col[has], y[mine]))
        (r, c, yy), (r2, c2, y2) = parts
        if len(set(yy.tolist())) < 2:
            return PENALTIES[0]
        some = telling(r, c, yy > 0, columns)
        r, c = r[some[c]], c[some[c]]
        for k, penalty in enumerate(PENALTIES):
            w, t = fit_ordinal(r, c, yy, columns, grades, penalty, TRIAL_STEPS)
            total[k] += loss(w, t, r2, c2, y2)
    return PENALTIES[int(total.argmin())]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, graded: bool = False, seed: int = SEED) -> Model:
    """Trains on at most `rows` labelled documents. graded: the label holds grades 0, 1, 2, ... itself.

    Without labelled documents of at least two grades no text is toxic: all get severity 0.
    """
    sample = _sample.labelled_sample(docs, labels, label, rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.parts(batches):
            data, offsets, _ = _text.column_buffers(b.column(1))
            found = []
            for i, j in _text.groups(offsets):
                row, word = words_of(data, offsets[i : j + 1])
                cut = np.searchsorted(row, np.arange(j - i + 1))
                found += [word[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "words"])

    got = sorted(sample.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id bigint, label int, words binary").collect())
    y = np.array([max(r.label, 0) for r in got], int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << HASH_BITS), np.array([np.inf]))
    per = [np.frombuffer(r.words, np.int32) for r in got]
    row, word = np.repeat(np.arange(len(per)), [len(x) for x in per]), np.concatenate(per)
    vocabulary, col = np.unique(word, return_inverse=True)
    often = telling(row, col, y > 0, len(vocabulary))
    if not graded:
        y = grade(row, col, y, len(vocabulary))
    renamed = np.cumsum(often) - 1
    has = often[col]
    row, col, columns, n = row[has], renamed[col[has]], int(often.sum()), int(y.max()) + 1
    w, t = fit_ordinal(row, col, y, columns, n, chosen_penalty(row, col, y, columns, n))
    weights = np.zeros(1 << HASH_BITS)
    weights[vocabulary[often]] = w
    return Model(weights, t)


def grades(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, toxic), one row for each row of docs.

    severity is the expected grade; toxic: the chance of a grade above 0 is at least FLAG_AT; grade is the
    number of thresholds that the text is more likely than not above, at least 1 if it is toxic. Null texts have severity null, grade null and aren't
    toxic; empty texts are graded by the thresholds alone. Null ids stay null, repeated rows get equal
    rows, texts of any length count whole, other columns aren't looked at; empty in, empty out.
    """
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))  # at most the sample's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, thresholds = shared.value
        m = Model(np.zeros(1 << HASH_BITS), thresholds)
        m.weights[at] = w
        for b in _text.parts(batches):
            data, offsets, null = _text.column_buffers(b.column(1))
            s = np.zeros(len(null))
            for i, j in _text.groups(offsets):
                row, word = words_of(data, offsets[i : j + 1])
                s[i:j] = np.bincount(row, weights=m.weights[word], minlength=j - i)
            p = m.above(s)
            toxic = ~null & (p[:, 0] >= FLAG_AT)
            grade = np.maximum((p >= 0.5).sum(1), toxic)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1), mask=null), pa.array(grade.astype(np.int32), mask=null), pa.array(toxic)], ["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, severity double, grade int, toxic boolean")
