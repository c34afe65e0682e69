"""k-means: seeding on a bounded sample, Lloyd's iterations over distributed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distance, kernels
from tessera.operators import nearest

#: Vectors that centroids are fitted on; limits of Lloyd's iterations; the largest squared shift that counts as none.
SAMPLE, MAX_ITERATIONS, TOLERANCE = 100_000, 100, 1e-4


def sample_vectors(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n vectors (or all), the same for the same seed: those of least hash of vec_id, a multiplicative one that SQL has too.

    Rows above a hash that twice as many lie under on average are left out first, so that what one task orders
    doesn't grow with the number of tasks. Null ids are left out.
    """
    vectors = vectors.where("vec_id is not null")
    h, total = (F.col("vec_id") * 2654435761 + seed) % 4294967296, vectors.count()
    if total > 4 * (n + 1000):
        some = vectors.where(h < int(4294967296 * (2 * n + 1000) / total))
        if some.count() >= n:
            vectors = some
    return vectors.orderBy(h, "vec_id").limit(n)


def seed_plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres from rows of x: the first at random, others with chances in proportion to squared distance from those there are."""
    rows = [int(rng.integers(len(x)))]
    far = kernels.exact_l2(x, np.repeat(x[rows], len(x), 0))
    while len(rows) < k:
        total = far.sum()
        pick = int(rng.integers(len(x))) if total <= 0 else min(int(np.searchsorted(np.cumsum(far), rng.random() * total, "right")), len(x) - 1)
        rows.append(pick)
        far = np.minimum(far, kernels.exact_l2(x, np.repeat(x[[pick]], len(x), 0)))
    return x[rows]


def centers_frame(spark: SparkSession, x: np.ndarray, counts: np.ndarray | None = None) -> DataFrame:
    """(cid, cv, cnt) of a matrix of centroids."""
    n = np.zeros(len(x), np.int64) if counts is None else counts
    return spark.createDataFrame([(i, list(map(float, v)), int(c)) for i, (v, c) in enumerate(zip(x, n, strict=True))], "cid int, cv array<double>, cnt bigint")


def cluster_sums(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """(cid, n, s, inertia): members of each centroid, their sums by dimension and squared distances; added up per task first."""
    shared, dim = vectors.sparkSession.sparkContext.broadcast(centers), centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        ids = np.arange(len(c))
        n, s, inertia = np.zeros(len(c), np.int64), np.zeros((len(c), dim)), np.zeros(len(c))
        for b in batches:
            x, _ = kernels.usable(b.column(0), dim)
            r, cid, d = kernels.nearest(x, c, ids, 1)
            n += np.bincount(cid, minlength=len(c))
            inertia += np.bincount(cid, weights=d, minlength=len(c))
            np.add.at(s, cid, x[r])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(s[some]), pa.list_(pa.float64())), pa.array(inertia[some])], ["cid", "n", "s", "inertia"])

    parts = vectors.select("embedding").mapInArrow(run, "cid int, n bigint, s array<double>, inertia double")
    return parts.groupBy("cid").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s"), F.sum("inertia").alias("inertia"))


def lloyd(vectors: DataFrame, centers: np.ndarray, iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, int, float]:
    """(centroids, index of the last iteration, inertia before it).

    Ties go to the lesser centroid; one without members stays where it is; it ends when no squared
    shift is above the tolerance. Index -1: there was nothing to do (no centroids or no iterations).
    """
    last, inertia = -1, 0.0
    for last in range(iterations if len(centers) else 0):
        moved, inertia = centers.copy(), 0.0
        for r in cluster_sums(vectors, centers).collect():  # a row for each centroid
            moved[r.cid] = np.array(r.s) / r.n
            inertia += r.inertia
        shift = kernels.exact_l2(moved, centers).max()
        centers = moved
        if shift <= tolerance:
            break
    return centers, last, inertia


def kmeans(vectors: DataFrame, k: int, sample: int = SAMPLE, restarts: int = 1, seed: int = 42, iterations: int = MAX_ITERATIONS) -> DataFrame:
    """(cid, cv, cnt): the best of several runs by inertia. Counts start at 0, so a centroid's first member replaces it."""
    some = sample_vectors(vectors, sample, seed)
    x = nearest.Table(some, "vec_id", "embedding", sample, mixed=True).vectors
    if not len(x):
        raise ValueError("no vectors to cluster")
    best, least = None, np.inf
    for run in range(max(1, restarts)):
        start = seed_plus_plus(x, k, np.random.default_rng(seed + run))
        # the sample is bounded and already here: iterate on it as it is
        centers, inertia = start, np.inf
        for _ in range(iterations):
            r, cid, d = kernels.nearest(x, centers, np.arange(k), 1)
            n, s = np.bincount(cid, minlength=k), np.zeros_like(centers)
            np.add.at(s, cid, x[r])
            moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centers)
            shift, centers, inertia = kernels.exact_l2(moved, centers).max(), moved, d.sum()
            if shift <= TOLERANCE:
                break
        if inertia < least:
            best, least = centers, inertia
    return centers_frame(vectors.sparkSession, best)


def inertia(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(inertia): the sum of squared distances to the nearest centroid."""
    return nearest.assign(vectors, centers).agg(F.sum("d").alias("inertia"))


def centers_from_sums(assigned: DataFrame, centers: DataFrame, dim: int) -> DataFrame:
    """(cid, cv, cnt) from rows (cid, embedding) alone: sum / max(count, 1), so a centroid without members goes to the origin (the simulator's rule)."""
    rows = assigned.select("cid", distance.doubles("embedding").alias("v"))
    sums = rows.groupBy("cid").agg(F.count("*").alias("cnt"), F.array(*[F.sum(F.col("v")[i]) for i in range(dim)]).alias("s"))
    joined = centers.select("cid").join(sums, "cid", "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return joined.select("cid", F.transform(F.coalesce("s", zero), lambda x: x / F.greatest(F.coalesce("cnt", F.lit(0)), F.lit(1))).alias("cv"), F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def center_count_stats(centers: DataFrame) -> DataFrame:
    """(total, zero, nonzero, min, max, mean) of the centroids' counts; the mean over those that aren't 0."""
    c = F.col("cnt")
    return centers.agg(F.sum(c).alias("total"), F.count_if(c == 0).alias("zero"), F.count_if(c > 0).alias("nonzero"), F.min(c).alias("min_count"), F.max(c).alias("max_count"), F.avg(F.when(c > 0, c)).alias("mean_nonzero"))
