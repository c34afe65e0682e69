"""Operator 2, exact top-k search: every vector, or every so many-th, is a query against all others.

Vectors are laid out in square blocks. Each task takes a block of queries past a part of all blocks and
keeps the k best so far, so that a product in single precision and one comparison with the k-th best
leave few candidates to compute exactly. It sends one list for each query; lists of one query block are
merged in a tree, MERGE parts at a time, so that no task reads more than MERGE lists of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _shared, _text

K, BLOCK, MERGE = 10, 4096, 8
#: The product has about TASKS tasks or, so that a part of the blocks is no more than PART_BYTES, more; queries are in SIDE_MOST partitions at most.
TASKS, PART_BYTES, SIDE_MOST = 64, 32 << 20, 1024
#: Queries that a matrix product takes at a time; decimals that scores are rounded to.
SLICE, DECIMALS = 256, 9
#: If more than this share of a product are candidates, it is repeated in double precision. Pairs that are computed exactly at a time.
DENSE, PAIRS = 1 / 16, 2048


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added in order and rounded, so that they don't depend on the tile."""
    s = np.zeros(len(a))
    for products in np.ascontiguousarray((a * b).T):
        s += products
    return np.round(s, DECIMALS) + 0.0


def _lengths(a: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, whatever their magnitude."""
    most = np.abs(a).max(axis=1, initial=0.0).astype(np.float64)
    part = a / np.where(most > 0, most, 1)[:, None]
    return most * np.sqrt((part * part).sum(1))


def _reached(s: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that k + 1 entries reach: of greatest values of groups if there are many entries."""
    groups = 16 * (k + 1)
    if s.shape[1] >= 2 * groups:
        s = s[:, : s.shape[1] // groups * groups].reshape(len(s), -1, groups).max(1)
    return np.partition(s, -k - 1, axis=1)[:, -k - 1].astype(np.float64) if s.shape[1] > k else np.full(len(s), -np.inf)


def _set(flags: np.ndarray) -> np.ndarray:
    """Where flags are set; quick if few are."""
    if len(flags) % 64:
        return np.flatnonzero(flags)
    words = np.flatnonzero(np.packbits(flags).view(np.uint64))
    word, bit = np.nonzero(flags.reshape(-1, 64)[words])
    return words[word] * 64 + bit


class Best:
    """The k best of each query so far, without itself: ids and rounded scores, filled up with -1 and -inf. Ties go to the lesser id."""

    def __init__(self, query: np.ndarray, query_id: np.ndarray, k: int):
        self.q, self.own, self.k = np.asarray(query, np.float64), query_id, k
        self.length = _lengths(self.q)
        self.unit = (self.q / np.where(self.length > 0, self.length, 1)[:, None]).astype(np.float32)
        self.ids, self.scores = np.full((len(query), k), -1, np.int64), np.full((len(query), k), -np.inf)
        # memory that is used again and again, for one slice
        self.products, self.low = np.empty((0, 0), np.float32), np.empty((0, 0), bool)

    def add(self, shard: np.ndarray, shard_id: np.ndarray) -> None:
        """Takes in a shard; no id may come twice."""
        if not len(shard):
            return
        longest = _lengths(shard).max()
        near, dim = (shard / (longest or 1.0)).astype(np.float32), shard.shape[1]
        if self.products.shape[1] != len(shard):
            self.products, self.low = np.empty((SLICE, len(shard)), np.float32), np.empty((SLICE, len(shard)), bool)
        for i in range(0, len(self.q), SLICE):
            scale = self.length[i : i + SLICE] * longest
            s = np.matmul(self.unit[i : i + SLICE], near.T, out=self.products[: len(scale)])
            row, col = self._candidates(s, i, np.where(scale > 0, scale, 1), (dim + 8) * 2.0**-24)
            if len(row) > DENSE * s.size:
                row, col = self._candidates(self.q[i : i + SLICE] @ shard.T.astype(np.float64), i, np.ones(len(scale)), (dim + 8) * 2.0**-52 * scale)
            some = self.own[i + row] != shard_id[col]
            row, col = i + row[some], col[some]
            if len(row):
                self._merge(row, shard_id[col], np.concatenate([_exact(self.q[row[j : j + PAIRS]], shard[col[j : j + PAIRS]].astype(np.float64)) for j in range(0, len(row), PAIRS)]))

    def _candidates(self, s: np.ndarray, i: int, unit: np.ndarray, off: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of s that may be among the k best. s: inner products over unit, with an error up to off."""
        known = self.scores[i : i + SLICE, -1]
        with np.errstate(over="ignore", invalid="ignore"):
            rounding = 2 * 10.0**-DECIMALS
            floor = (known - rounding) / unit - off
            if (new := known == -np.inf).any():
                floor[new] = (_reached(s, self.k) - 2 * off - rounding / unit)[new]
            floor[~np.isfinite(unit + off)] = -np.inf
            floor = np.nextafter(floor.astype(s.dtype), s.dtype.type(-np.inf))
        low = np.less(s, floor[:, None], out=self.low[: len(s)])
        return np.divmod(_set(np.logical_not(low, out=low).ravel()), s.shape[1])

    def _merge(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes in candidates, by row."""
        touched, first, count = np.unique(row, return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(touched)), count), self.k + np.arange(len(row)) - np.repeat(first, count)
        both_ids, both = np.full((len(touched), self.k + count.max()), -1, np.int64), np.full((len(touched), self.k + count.max()), -np.inf)
        both_ids[:, : self.k], both[:, : self.k] = self.ids[touched], self.scores[touched]
        both_ids[at], both[at] = ids, scores
        self.ids[touched], self.scores[touched] = merge(both_ids, both, self.k)


def best(query: np.ndarray, query_id: np.ndarray, shard: np.ndarray, shard_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of each query's k best in one shard."""
    out = Best(query, query_id, k)
    out.add(shard, shard_id)
    return out.ids, out.scores


def merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row's lists (rows x entries)."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def search(vectors: DataFrame, k: int = K, block: int = BLOCK, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k others of greatest inner product for each vector; rank from 1.

    Queries are the vectors whose id is divisible by `every`; answers come from all. vectors has vec_id and embedding. Rows with null id or vector, a null or not finite entry or another
    dimension than most have are left out, as queries and as answers; an id given several times counts
    once, with the least of its vectors. Ties in the rounded score go to the lesser id. Fewer than k
    others give fewer rows; an empty table gives none; other columns aren't looked at.
    """
    # floats are kept as such; only the block at work is widened
    floats = vectors.select("embedding").schema[0].dataType.simpleString() == "array<float>"
    stored = np.dtype(np.float32 if floats else np.float64)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if floats else "array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    asked = F.col("vec_id") % every == 0
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).orderBy(F.desc("n"), "d").first()
    dim, n, n_asked = dims or (1, 0, 0)
    rows = rows.where(F.size("v") == dim)

    def lay(part: pa.Table) -> pa.Table:
        values = part.column("v").combine_chunks()
        values = values if isinstance(values, pa.Array) else values.chunk(0)
        return pa.table({"b": pa.array([part.column("b")[0].as_py()], pa.int32()), "ids": pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()), "vs": pa.array([values.flatten().to_numpy().astype(stored).tobytes()], pa.binary())})

    def laid(some: DataFrame, blocks: int) -> DataFrame:
        # one shuffle: rows of a block are together, so those of an id are
        some = some.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition("b").groupBy("b", "vec_id").agg(F.min("v").alias("v")).groupBy("b").applyInArrow(lay, "b int, ids binary, vs binary")
        return _shared.materialize(some, "blocks")

    blocks, sides = max(1, -(-n // block)), max(1, -(-n_asked // block))
    shards = laid(rows, blocks)
    sought = shards if every == 1 else laid(rows.where(asked), sides)
    # both sides are spread over partitions once; tiles themselves are never shuffled
    spread = min(sides, SIDE_MOST)
    each = max(1, min(-(-blocks * spread // TASKS), PART_BYTES // (block * (dim * stored.itemsize + 8))))
    parts = -(-blocks // each)
    sought = sought.repartitionById(spread, F.col("b"))
    shards = shards.select(F.col("b").alias("b2"), F.col("ids").alias("ids2"), F.col("vs").alias("vs2")).repartitionById(parts, F.expr(f"b2 div {each}").cast("int"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by query block, each with all blocks of one part; one list leaves for each."""
        now, ids, found = None, b"", None

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([ids], pa.binary()), pa.array([found.ids.tobytes()], pa.binary()), pa.array([found.scores.tobytes()], pa.binary())], ["b", "x", "ids", "got", "scores"])

        for batch in batches:
            for r in range(batch.num_rows):
                b, ids1, vs, b2, ids2, vs2 = (c[r].as_buffer() if pa.types.is_binary(c.type) else c[r].as_py() for c in batch.columns)
                if now != (b, b2 // each):
                    if now:
                        yield sent()
                    now, ids = (b, b2 // each), ids1.to_pybytes()
                    found = Best(np.frombuffer(vs, stored).reshape(-1, dim), np.frombuffer(ids, np.int64), k)
                found.add(np.frombuffer(vs2, stored).reshape(-1, dim), np.frombuffer(ids2, np.int64))
        if now:
            yield sent()

    schema = "b int, x int, ids binary, got binary, scores binary"
    lists = sought.crossJoin(shards.hint("shuffle_replicate_nl")).mapInArrow(tiles, schema)

    def join(part: pa.Table) -> pa.Table:
        got, scores = (np.concatenate([np.frombuffer(c, kind).reshape(-1, k) for c in part.column(name).to_pylist()], axis=1) for name, kind in (("got", np.int64), ("scores", np.float64)))
        got, scores = merge(got, scores, k)
        return pa.table([pa.array([part.column("b")[0].as_py()], pa.int32()), pa.array([part.column("x")[0].as_py() // MERGE], pa.int32()), part.column("ids").slice(0, 1).combine_chunks(), pa.array([got.tobytes()], pa.binary()), pa.array([scores.tobytes()], pa.binary())], ["b", "x", "ids", "got", "scores"])

    left = max(parts, min(blocks, 2))  # so that lists of one query block are put together in whatever order its tiles came
    while left > 1:
        lists = lists.groupBy("b", F.floor(F.col("x") / MERGE).alias("up")).applyInArrow(join, schema)
        left = -(-left // MERGE)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[r].as_py(), np.int64)
                got, scores = np.frombuffer(batch.column(3)[r].as_py(), np.int64), np.frombuffer(batch.column(4)[r].as_py(), np.float64)
                some = scores > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[some]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))[some]), pa.array(got[some]), pa.array(scores[some])], ["vec_id", "rank", "neighbor_id", "score"])

    return lists.mapInArrow(unfold, "vec_id bigint, rank int, neighbor_id bigint, score double")
