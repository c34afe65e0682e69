"""Nearest neighbours: of queries among centroids, and exactly among all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import kernels

#: Rows of a centroid or query table that are sent to every task at most; more queries go in several passes.
MAX_CENTERS, QUERY_SLICE = 200_000, 8192


class TooMany(ValueError):
    """A table that goes to every task is too large."""


class Table:
    """Ids and vectors of a small table, on the driver; its size is checked. Rows without id or usable vector are left out.

    dim: vectors of another dimension are left out too. If it isn't given, all must have the same, or, if mixed,
    it is the one that most have (of equally many, the larger).
    """

    def __init__(self, df: DataFrame, id_: str, vector: str, most: int, also: str | None = None, dim: int | None = None, mixed: bool = False):
        got = df.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"), *([F.col(also).alias("also")] if also else [])).where("id is not null").limit(most + 1).toArrow()
        if got.num_rows > most:
            raise TooMany(f"more than {most} rows in a table that goes to every task")
        if dim is None:
            sizes, rows = np.unique([n for n in pc.list_value_length(got.column("v")).to_pylist() if n], return_counts=True)
            if len(sizes) > 1 and not mixed:
                raise ValueError(f"vectors of dimensions {', '.join(map(str, sizes))} in one table")
            dim = int(sizes[rows == rows.max()][-1]) if len(sizes) else 1
        self.dim = dim
        self.vectors, rows = kernels.usable(got.column("v"), self.dim)
        self.ids = got.column("id").to_numpy()[rows]
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.vectors = self.ids[order], self.vectors[order]
        self.also = got.column("also").to_numpy()[rows][order] if also else None


def closest_centers(queries: DataFrame, centers: DataFrame, n: int, id_: str = "qid", vector: str = "qv", keep: tuple[str, ...] = (), shard: bool = False) -> DataFrame:
    """(id, rn, cid, d) and the columns to keep: the n nearest centroids of each query, nearest first; ties go to the lesser cid.

    shard: with the centroid's pid besides. Queries without a usable vector (null, with a null, NaN or infinite
    element, of another dimension) have no rows.
    """
    table = Table(centers, "cid", "cv", MAX_CENTERS, "pid" if shard else None)
    shared = queries.sparkSession.sparkContext.broadcast((table.ids, table.vectors, table.also))
    dim = table.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, pid = shared.value
        for b in kernels.pieces(batches):
            q, rows = kernels.usable(b.column(1), dim)
            r, c, d = kernels.nearest(q, x, ids, n)
            rn = np.arange(len(r)) - np.searchsorted(r, r) + 1
            at = pa.array(rows[r])
            kept = [b.column(2 + k).take(at) for k in range(len(keep))]
            shards = [pa.array(pid[c].astype(np.int32))] if shard else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(rn.astype(np.int32)), pa.array(ids[c].astype(np.int32)), pa.array(d), *shards, *kept], [id_, "rn", "cid", "d", *(["pid"] if shard else []), *keep])

    # elements are widened to doubles in the kernel, not before
    rows = queries.select(F.col(id_).cast("bigint").alias(id_), F.col(vector).alias("_v"), *keep)
    schema = T.StructType().add(id_, T.LongType()).add("rn", T.IntegerType()).add("cid", T.IntegerType()).add("d", T.DoubleType())
    if shard:
        schema.add("pid", T.IntegerType())
    for name in keep:
        schema.add(rows.schema[name])
    return rows.mapInArrow(run, schema)


def assign(vectors: DataFrame, centers: DataFrame, keep: tuple[str, ...] = (), shard: bool = False) -> DataFrame:
    """(vec_id, cid, d), maybe pid, and the columns to keep: the nearest centroid of each usable vector."""
    return closest_centers(vectors, centers, 1, "vec_id", "embedding", keep, shard).drop("rn")


def first_by_shard(queries: DataFrame, router: DataFrame, shards: int, depth: int = 0) -> DataFrame:
    """(qid, pid, rn): the nearest centroid of each of the nearest `shards` shards (and maybe of more), by its place among all centroids of the query.

    Starts from 10 times as many centroids as shards, depth at least, and from 10 times more for those
    queries that haven't met enough shards. Shards that aren't given have no centroid among the depth nearest.
    """
    table = Table(router, "cid", "cv", MAX_CENTERS, "pid")
    shared = queries.sparkSession.sparkContext.broadcast((table.ids, table.vectors, table.also.astype(np.int32)))
    dim, wanted = table.dim, min(shards, len(set(table.also.tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, pid = shared.value
        width = int(pid.max(initial=0)) + 1
        for b in kernels.pieces(batches):
            q, rows = kernels.usable(b.column(1), dim)
            n, todo = min(len(ids), max(10 * shards, depth)), np.arange(len(q))
            while len(todo) and len(ids):
                r, c, _ = kernels.nearest(q[todo], x, ids, n)
                rn = np.arange(len(r)) - np.searchsorted(r, r) + 1
                first = np.unique(r * width + pid[c], return_index=True)[1]
                done = (np.bincount(r[first], minlength=len(todo)) >= wanted) | (n == len(ids))
                first = first[done[r[first]]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[todo[r[first]]])), pa.array(pid[c[first]]), pa.array(rn[first].astype(np.int32))], ["qid", "pid", "rn"])
                todo, n = todo[~done], min(len(ids), 10 * n)

    return queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("qv").alias("v")).mapInArrow(run, "qid bigint, pid int, rn int")


def _slices(queries: DataFrame) -> list[Table]:
    """Queries in tables that may go to every task. A pass over the vectors for each costs less than its distances.

    Queries have the dimension that most of them have (of equally many, the larger); others are left out.
    """
    try:
        return [Table(queries, "qid", "qv", QUERY_SLICE, mixed=True)]
    except TooMany:
        sizes = queries.where("qid is not null and size(qv) > 0").groupBy(F.size("qv").alias("dim")).count().collect()
        dim = max(((r["count"], r.dim) for r in sizes), default=(0, 1))[1]
        n = -(-sum(r["count"] for r in sizes) // QUERY_SLICE) + 1  # parts by hash are uneven
        usable = queries.where(F.size("qv") == dim)
        return [Table(usable.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == k), "qid", "qv", 2 * QUERY_SLICE, dim=dim) for k in range(n)]


def scan_topk(vectors: DataFrame, queries: DataFrame, k: int, routes: DataFrame | None = None, exclude_self: bool = False, router: DataFrame | None = None) -> DataFrame:
    """(qid, vec_id, d), and pid with routes: candidates from one pass over vectors, of each task its k best for each query (and shard).

    A task keeps its k best over all its batches and gives them at its end. routes (qid, pid) restricts a
    query to shards; vectors then need pid, and other shards aren't read. With a router vectors need no pid: the
    task itself takes that of the nearest centroid, as `assign` does, so vectors go through one Python worker
    instead of two. Vectors and queries that can't be worked with (`kernels.usable`) are passed over.
    """
    out = None
    spark = queries.sparkSession
    centers = Table(router, "cid", "cv", MAX_CENTERS, "pid") if router is not None and routes is not None else None
    near = spark.sparkContext.broadcast((centers.ids, centers.vectors, centers.also.astype(np.int32))) if centers else None
    for table in _slices(queries):
        ask: dict[int, np.ndarray] = {}
        source, columns = vectors, ["vec_id", "embedding"]
        if routes is not None:
            mine = spark.createDataFrame([(q,) for q in table.ids.tolist()], "qid bigint")
            pairs = routes.select("qid", "pid").join(F.broadcast(mine), "qid", "left_semi").distinct().toArrow()
            at, pid = np.searchsorted(table.ids, pairs.column("qid").to_numpy()), pairs.column("pid").to_numpy()
            ask = {int(p): np.sort(at[pid == p]) for p in np.unique(pid)}
            if near is None:
                source, columns = vectors.where(F.col("pid").isin(sorted(ask))), [*columns, "pid"]
            elif centers.dim != table.dim:  # no vector can have both dimensions
                source = vectors.where("false")
        shared = spark.sparkContext.broadcast((table.ids, table.vectors, ask))
        dim = table.dim

        def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            qids, q, ask = shared.value
            best: dict[int | None, kernels.Best] = {}
            for b in kernels.pieces(batches):
                x, rows = kernels.usable(b.column(1), dim)
                ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
                pid = b.column(2).to_numpy()[rows] if b.num_columns > 2 else None
                if near is not None:
                    cids, cv, shards = near.value
                    r, c, _ = kernels.nearest(x, cv, cids, 1)
                    x, ids, pid = x[r], ids[r], shards[c]
                for p in [None] if pid is None else [p for p in np.unique(pid).tolist() if p in ask]:
                    some = slice(None) if p is None else pid == p
                    if p not in best:
                        asked = slice(None) if p is None else ask[p]
                        best[p] = kernels.Best(q[asked], qids[asked] if exclude_self else None, k)
                    best[p].add(x[some], ids[some])
            for p, found in best.items():
                r, ids, d = found.rows()
                names = qids if p is None else qids[ask[p]]
                yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(ids), pa.array(d), *([] if p is None else [pa.array(np.full(len(r), p, np.int32))])], ["qid", "vec_id", "d", *([] if p is None else ["pid"])])

        found = source.select(*columns).where("vec_id is not null").mapInArrow(run, "qid bigint, vec_id bigint, d double" + (", pid int" if routes is not None else ""))
        out = found if out is None else out.unionAll(found)
    return out


def topk(candidates: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vec_id, d): the k nearest of each query; an id counts once; ties go to the lesser id. One shuffle, by query."""
    once = candidates.repartition("qid").groupBy("qid", "vec_id").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "d")


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, exclude_self: bool = True) -> DataFrame:
    """(qid, rank, vec_id, d): the true k nearest of each query among the vectors that `where` lets through."""
    return topk(scan_topk(vectors if where is None else vectors.where(where), queries, k, exclude_self=exclude_self), k)


def epsilon_search(vectors: DataFrame, queries: DataFrame, eps: float) -> DataFrame:
    """(qid, vec_id, d): all usable vectors within the squared distance eps, but the query itself."""
    out = None
    for table in _slices(queries):
        shared, dim = queries.sparkSession.sparkContext.broadcast((table.ids, table.vectors)), table.dim

        def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            for b in kernels.pieces(batches):
                x, rows = kernels.usable(b.column(1), dim)
                ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
                r, c, d = kernels.within(q, x, eps)
                other = qids[r] != ids[c]
                yield pa.RecordBatch.from_arrays([pa.array(qids[r][other]), pa.array(ids[c][other]), pa.array(d[other])], ["qid", "vec_id", "d"])

        found = vectors.select("vec_id", "embedding").where("vec_id is not null").mapInArrow(run, "qid bigint, vec_id bigint, d double")
        out = found if out is None else out.unionAll(found)
    return out


def multivector_search(vectors: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc, d): the k documents with the nearest usable vector each; docs: (vec_id, doc).

    A task gives its k nearest documents of each query: one of the k nearest of all is among those of the
    task that holds its nearest vector.
    """
    out = None
    rows_ = vectors.select("vec_id", "embedding").join(docs.select("vec_id", F.col("doc").cast("bigint").alias("doc")).where("doc is not null"), "vec_id")
    for table in _slices(queries):
        shared, dim = queries.sparkSession.sparkContext.broadcast((table.ids, table.vectors)), table.dim

        def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            best = kernels.Best(q, qids, k)
            for b in kernels.pieces(batches):
                x, rows = kernels.usable(b.column(1), dim)
                best.add_grouped(x, b.column(0).to_numpy()[rows], b.column(2).to_numpy()[rows])
            r, doc, d = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(doc), pa.array(d)], ["qid", "vec_id", "d"])

        found = rows_.mapInArrow(run, "qid bigint, vec_id bigint, d double")
        out = found if out is None else out.unionAll(found)
    return topk(out, k).withColumnRenamed("vec_id", "doc")
