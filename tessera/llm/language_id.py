"""Operator 3, language identification: string kernels with Nyström landmarks and kernel ridge regression.

The blended-spectrum presence kernel of two texts is the number of byte n-grams (2 to 4 bytes, lower
case, hashed to HASH_BITS bits) that both hold, divided by the root of the product of how many each
holds. Landmark texts give the Nyström map; one-versus-rest ridge regression is fitted on it. A text's
scores are its kernel values with the landmarks times a matrix. As kernel values are themselves
products of presence rows, the matrices are multiplied once: a batch is scored by the product of its
sparse presence matrix (texts x n-grams) and one dense matrix (n-grams x languages).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _shared, _text

ORDERS, HASH_BITS = (2, 3, 4), 18
#: Labelled documents used for training at most, over all languages.
TRAIN_ROWS = 1600
#: Landmarks, drawn from the training rows. Each document also gives a row of so many bytes from its middle, so that short texts are learnt too.
LANDMARKS, PIECE = 480, 120
PENALTY = 1e-2
#: A text whose scores are nearer to 0 than this on average shares too few n-grams with the landmarks to be of a trained language.
MIN_EVIDENCE = 0.15
SEED = 5


def _hashed(low: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the n-gram that begins at each byte) for each order."""
    code = low.astype(np.uint32)
    last = code
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(256) + last[n - 1 :] if len(code) > 1 else code[:0]
        if n in ORDERS:
            h = (code ^ np.uint32(n * 0x61C88647 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            yield n, h >> np.uint32(32 - HASH_BITS)


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of the distinct hashed n-grams of each text, by row; for one group of at most CHUNK_DOCS texts."""
    o = offsets - offsets[0]
    raw = data[offsets[0] : offsets[-1]]
    if len(o) == 2 and len(raw) > _text.WINDOW:  # a long text: windows that overlap by the longest n-gram but a byte
        seen = np.zeros(1 << HASH_BITS, bool)
        for a, b in _text.windows(len(raw)):
            for _, h in _hashed(_text.lowered(raw, a, b + max(ORDERS) - 1)):
                seen[h] = True
        gram = np.flatnonzero(seen)
        return np.zeros(len(gram), np.int64), gram
    row = np.repeat(np.arange(len(o) - 1, dtype=np.uint32), np.diff(o))
    keys = []
    for n, h in _hashed(_text.lowered(raw)):
        own = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
        keys.append(((row[: len(h)] << np.uint32(HASH_BITS)) | h)[own])
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key >> np.uint32(HASH_BITS)).astype(np.int64), (key & np.uint32((1 << HASH_BITS) - 1)).astype(np.int64)


def each_presence(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    row, gram = presence(data, offsets)
    cut = np.searchsorted(row, np.arange(len(offsets)))
    return [gram[cut[k] : cut[k + 1]] for k in range(len(offsets) - 1)]


def _packed(gram: np.ndarray) -> bytes:
    """n-grams as numbers, or as a bit for each possible one where that is shorter: a long text takes 32 kB at most."""
    if 4 * len(gram) < (1 << HASH_BITS) // 8:
        return gram.astype(np.int32).tobytes()
    flags = np.zeros(1 << HASH_BITS, bool)
    flags[gram] = True
    return np.packbits(flags).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32) if len(raw) < (1 << HASH_BITS) // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


class Model:
    """matrix: (n-grams x languages)."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in _text.groups(offsets):
            if offsets[j] == offsets[i]:
                continue
            row, gram = presence(data, offsets[i : j + 1])
            norm = np.sqrt(np.maximum(np.bincount(row, minlength=j - i), 1))
            for c in range(len(self.languages)):  # sparse times dense, a column at a time
                out[i:j, c] = np.bincount(row, weights=self.matrix[c][gram], minlength=j - i) / norm
        return out


def kernel(rows: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """Normalised kernel values of texts and landmarks, each given by its n-grams."""
    vocabulary, at = np.unique(np.concatenate(landmarks), return_inverse=True)
    dense = np.zeros((len(vocabulary) + 1, len(landmarks)), bool)
    dense[at, np.repeat(np.arange(len(landmarks)), [len(x) for x in landmarks])] = True
    column = np.full(1 << HASH_BITS, len(vocabulary))
    column[vocabulary] = np.arange(len(vocabulary))
    shared = np.zeros((len(rows), len(landmarks)))
    for k, x in enumerate(rows):
        held = column[x]
        held = held[held < len(vocabulary)]
        for i in range(0, len(held), 1 << 14):
            shared[k] += dense[held[i : i + (1 << 14)]].sum(0, dtype=np.int32)
    return shared / np.sqrt(np.outer([max(len(x), 1) for x in rows], [max(len(x), 1) for x in landmarks]))


def train(grams: list[np.ndarray], y: list[str], landmarks: int = LANDMARKS, penalty: float = PENALTY) -> tuple[Model, np.ndarray, list[np.ndarray]]:
    """The model, and for tests the coefficients on the landmarks and the landmarks' n-grams. grams and y are in random order."""
    languages = sorted(set(y))
    by = {c: [k for k, v in enumerate(y) if v == c] for c in languages}
    marks = [grams[k] for c in languages for k in by[c][: max(1, landmarks // len(languages))]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    some = values > 1e-6 * values[-1]
    root = vectors[:, some] / np.sqrt(values[some])
    z = kernel(grams, marks) @ root
    target = np.where(np.array(y)[:, None] == np.array(languages), 1.0, -1.0)
    weight = np.array([1 / len(by[c]) for c in y])[:, None] / len(languages)
    coefficients = root @ np.linalg.solve(z.T @ (weight * z) + penalty * np.eye(z.shape[1]) / len(y) * len(languages), z.T @ (weight * target))
    matrix = np.zeros((len(languages), 1 << HASH_BITS))
    for x, a in zip(marks, coefficients, strict=True):
        matrix[:, x] += (a / np.sqrt(max(len(x), 1)))[:, None]
    return Model(languages, matrix), coefficients, marks


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, seed: int = SEED) -> Model:
    """Trains on at most `rows` documents with a language in `lang`, as many of each language, by a hash of doc_id.

    Null ids, texts and languages and texts of a single character are left out; texts of any length are
    drawn and count whole. Without any, the model knows no language.
    """
    usable = docs.where("doc_id is not null and lang is not null and length(text) >= 2")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    # one pass ranks ids by language; how many of each are used follows from how many languages there are
    ranked = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(2, rows))
    ranked = _shared.materialize(ranked, "ranked")
    each = max(2, rows // max(ranked.select("lang").distinct().count(), 1))
    drawn = ranked.where(F.col("n") <= each).select("doc_id", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.parts(batches):
            data, offsets, _ = _text.column_buffers(b.column(1))
            found = []
            for i, j in _text.groups(offsets):
                found += map(_packed, each_presence(data, offsets[i : j + 1]))
            start = (offsets[:-1] + offsets[1:] - PIECE) // 2
            cuts = np.stack([np.maximum(start, offsets[:-1]), np.minimum(start + PIECE, offsets[1:])], axis=1)
            pieces = [_packed(each_presence(data, _characters(data, c))[0]) for c in cuts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary()), pa.array(pieces, pa.binary())], ["doc_id", "lang", "grams", "piece"])

    texts = usable.select("doc_id", "text", "lang").join(_shared.small(drawn), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = sorted(texts.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, lang string, grams binary, piece binary").collect())
    _shared.release(ranked)
    if not got:
        return Model([], np.zeros((0, 1 << HASH_BITS)))
    rows_ = [(x, r.lang) for r in got for x in (r.grams, r.piece)]
    order = np.random.default_rng(seed).permutation(len(rows_))
    return train([_unpacked(rows_[k][0]) for k in order], [rows_[k][1] for k in order], landmarks)[0]


def _characters(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The range without the rest of a character that begins before it, or of one that goes on after it."""
    a, b = cut.tolist()
    part = data[a:b]
    starts = np.flatnonzero((part & 0xC0) != 0x80)
    if not len(starts):
        return np.array([a, a])
    lead = int(part[starts[-1]])
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    end = b if starts[-1] + size <= len(part) else a + int(starts[-1])
    return np.array([a + int(starts[0]), max(end, a + int(starts[0]))])


def _decide(text: pa.Array, model: Model, min_evidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the best language, its score, whether it is accepted)."""
    data, offsets, null = _text.column_buffers(text)
    if not model.languages:
        return np.zeros(len(null), int), np.zeros(len(null)), np.zeros(len(null), bool)
    s = model.scores(data, offsets)
    best = s.argmax(1)
    top = s[np.arange(len(s)), best]
    return best, top, ~null & (np.abs(s).mean(1) >= min_evidence)


def identify(docs: DataFrame, model: Model, min_evidence: float = MIN_EVIDENCE) -> DataFrame:
    """(doc_id, language, score, keep), one row for each row of docs.

    language is null and keep false where the mean absolute score is below min_evidence, as for null, empty and
    blank texts and scripts not trained; ties go to the first language in alphabetical order. Repeated
    rows get equal rows, null ids stay null, texts of any length count whole, other columns aren't
    looked at; empty in, empty out. A model without languages accepts nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.matrix))  # a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        names = pa.array([*model.languages, None], pa.string())
        for b in _text.parts(batches):
            best, top, ok = _decide(b.column(1), model, min_evidence)
            yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(np.where(ok, best, len(names) - 1))), pa.array(top), pa.array(ok)], ["doc_id", "language", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, language string, score double, keep boolean")


def keep_known(docs: DataFrame, model: Model, min_evidence: float = MIN_EVIDENCE) -> DataFrame:
    """The rows of docs that `identify` keeps, with all their columns."""
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast((model.languages, model.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in _text.parts(batches):
            yield b.filter(pa.array(_decide(b.column(at), model, min_evidence)[2]))

    return docs.mapInArrow(run, docs.schema)
