"""The index: a router snapshot, live centroids and vectors laid out by shard, in a folder of versions.

Each change writes what it changes to a new version folder and then moves the pointer file, so readers
always see a whole state and a job that dies leaves the last one. Vectors lie in parts that never change: an
insert adds a part, a delete a range of ids in the pointer file, a delta rebuild a part with the vectors
that move; ids whose older rows no longer count are listed in a table beside them. So a change writes about as
much as it changes. A full rebuild, or many parts, put all into one part again.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clustering, graph, maintenance, nearest, routing, updates

#: Rows of a file of vectors about; parts, and ranges of deleted ids, before they are put together; replaced ids that go to every task.
ROWS_PER_FILE, MAX_PARTS, MAX_RANGES, BROADCAST_IDS = 1_000_000, 64, 256, 2_000_000
#: Breadths of a graph's building and search, which are kept or taken but change nothing: search in a shard is exact.
EF_CONSTRUCTION, EF = 200, 10


class Index:
    """path holds versions. router: (cid, cv, pid), the snapshot that routes; centers: (cid, cv, cnt), live; vectors by pid."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.timings: dict[str, float] = {}
        self.ef = EF
        #: (pid, departed, arrived, tombstones) of the last rebuild.
        self.report: list[tuple[int, int, int, int]] = []
        with open(os.path.join(path, "CURRENT")) as f:
            self.meta = json.load(f)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, self.meta[name]))

    router = property(lambda self: self._table("router"))
    centers = property(lambda self: self._table("centers"))
    dim = property(lambda self: self.meta["dim"])
    blocks = property(lambda self: self.meta["blocks"])

    @property
    def vectors(self) -> DataFrame:
        """(vec_id, embedding, cid, pid, deleted): the rows that count, tombstones among them."""
        out = None
        for part in self.meta["parts"]:
            df = self._part(part)
            df = df.withColumn("deleted", self._later("vec_id", part["version"]) | F.col("deleted"))
            newer = [r for r in self.meta["replaced"] if r["version"] > part["version"]]
            if newer:
                ids = self.spark.read.schema("vec_id bigint").parquet(*[os.path.join(self.path, r["path"]) for r in newer])
                df = df.join(F.broadcast(ids) if sum(r["rows"] for r in newer) <= BROADCAST_IDS else ids, "vec_id", "left_anti")
            df = df.select("vec_id", "embedding", "cid", "pid", "deleted")
            out = df if out is None else out.unionAll(df)
        return out

    def _part(self, part: dict) -> DataFrame:
        return self.spark.read.schema(f"vec_id bigint, embedding {self.meta['embedding']}, cid int, deleted boolean, pid int").parquet(os.path.join(self.path, part["path"]))

    def _later(self, id_: str, version: int):
        """Whether an id was deleted after a version."""
        out = F.lit(False)
        for at, start, end in self.meta["ranges"]:
            if at > version:
                out = out | F.col(id_).between(start, end - 1)
        return out

    @contextmanager
    def _timed(self, what: str):
        began = time.perf_counter()
        yield
        self.timings[what] = self.timings.get(what, 0.0) + time.perf_counter() - began

    @classmethod
    def build(cls, vectors: DataFrame, path: str, n_centers: int, blocks: int, seed: int = 0, degree: int = graph.DEGREE, initial_centers: DataFrame | None = None, assignments: DataFrame | None = None, ef_construction: int = EF_CONSTRUCTION) -> Index:
        """Centroids (or those given), their graph and partition, and every usable vector in its shard. assignments (vec_id, cid) need initial_centers.

        degree: neighbours of a centroid in the graph that is partitioned (twice the M of an index that is a graph).
        """
        if assignments is not None and initial_centers is None:
            raise ValueError("assignments need their centroids")
        index = cls._start(vectors.sparkSession, path, {"blocks": blocks, "step": 0, "degree": degree, "ef_construction": ef_construction})
        with index._timed("kmeans_s"):
            centers = initial_centers if initial_centers is not None else clustering.kmeans(vectors, n_centers, seed=seed)
            centers = centers.select("cid", F.col("cv").cast("array<double>").alias("cv"), F.lit(0).cast("bigint").alias("cnt"))
            index.meta["dim"] = dim = nearest.Table(centers, "cid", "cv", nearest.MAX_CENTERS).dim
        index._check(vectors)
        with index._timed("partition_s"):
            parts = graph.partition(centers, blocks, degree, seed=seed)
        index._write(router=centers.join(F.broadcast(parts), "cid").select("cid", "cv", "pid"))
        with index._timed("place_s"):
            if assignments is None:
                rows = routing.place(vectors, index.router, ("embedding",))
            else:
                rows = vectors.select("vec_id", "embedding").join(assignments.join(F.broadcast(parts), "cid").select("vec_id", "cid", "pid"), "vec_id")
            index._add(updates.once(rows), vectors.count())
        with index._timed("centers_s"):
            index._write(centers=updates.centers_after_insert(centers, index.vectors, dim) if assignments is None else clustering.centers_from_sums(index.vectors, centers, dim))
        index._commit()
        return index

    @classmethod
    def from_tables(cls, router: DataFrame, centers: DataFrame, vectors: DataFrame, path: str, dim: int, blocks: int) -> Index:
        """An index of tables made elsewhere."""
        index = cls._start(vectors.sparkSession, path, {"dim": dim, "blocks": blocks, "step": 0})
        index._write(router=router.select("cid", "cv", "pid"), centers=centers.select("cid", "cv", "cnt"))
        index._add(vectors, vectors.count())
        index._commit()
        return index

    @classmethod
    def from_state(cls, vectors: DataFrame, path: str, state: dict[str, DataFrame], blocks: int | None = None) -> Index:
        """An index of a step's state (see `sources.states`): vectors that have a label, each in its centroid's shard."""
        router = state["router"]
        blocks = blocks or (router.agg(F.max("pid")).first()[0] or 0) + 1
        rows = vectors.select("vec_id", "embedding").join(state["labels"], "vec_id").join(F.broadcast(router.select("cid", "pid")), "cid").withColumn("deleted", F.lit(False))
        return cls.from_tables(router, state["centers"], rows, path, nearest.Table(router, "cid", "cv", nearest.MAX_CENTERS).dim, blocks)

    @classmethod
    def _start(cls, spark: SparkSession, path: str, meta: dict) -> Index:
        os.makedirs(path, exist_ok=True)
        index = cls.__new__(cls)
        index.spark, index.path, index.timings, index.report, index.ef = spark, path, {}, [], EF
        index.meta = {"version": 0, "parts": [], "ranges": [], "replaced": []} | meta
        return index

    def _check(self, vectors: DataFrame) -> None:
        """An error if there are vectors, but none of the index's dimension."""
        n = F.size("embedding")
        if vectors.where(n == self.dim).isEmpty() and (other := vectors.where(n > 0).select(n.alias("n")).first()):
            raise ValueError(f"vectors of dimension {other.n} in an index of dimension {self.dim}")

    def _next(self, name: str) -> str:
        self.meta = self.meta | {"version": self.meta["version"] + 1}
        return f"v{self.meta['version']:06d}/{name}"

    def _write(self, **tables: DataFrame) -> None:
        """Tables of centroids."""
        for name, df in tables.items():
            to = self._next(name)
            df.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.path, to))
            self.meta[name] = to

    def _add(self, rows: DataFrame, about: int, alone: bool = False) -> dict:
        """Writes rows (vec_id, embedding, cid, pid, maybe deleted) as a new part, the only one if alone; about: how many they are at most."""
        rows = rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False))
        self.meta.setdefault("embedding", rows.schema["embedding"].dataType.simpleString())
        rows = rows.select("vec_id", F.col("embedding").cast(self.meta["embedding"]).alias("embedding"), "cid", F.col("deleted"), "pid")
        files = max(1, -(-about // (self.blocks * ROWS_PER_FILE)))
        to = self._next("vectors")
        # in order of ids within a file, so that ranges of ids (deletes) skip row groups
        out = rows.repartition("pid", F.pmod(F.xxhash64("vec_id"), F.lit(files))).sortWithinPartitions("pid", "vec_id").write.option("maxRecordsPerFile", ROWS_PER_FILE)
        out.partitionBy("pid").mode("overwrite").parquet(os.path.join(self.path, to))
        part = {"path": to, "version": self.meta["version"]}
        part |= self._sums(part)
        self.meta |= {"parts": [part]} if alone else {"parts": [*self.meta["parts"], part]}
        if alone:
            self.meta |= {"ranges": [], "replaced": []}
        return part

    def _sums(self, part: dict) -> dict:
        got = self._part(part).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("vec_id", "cid", "pid", "deleted")).alias("sum")).first()
        return {"rows": got.rows, "sum": got["sum"]}

    def _replace(self, ids: DataFrame) -> int:
        """From here on older rows of the ids don't count; gives their number."""
        to = self._next("replaced")
        ids.select("vec_id").write.mode("overwrite").parquet(os.path.join(self.path, to))
        n = self.spark.read.schema("vec_id bigint").parquet(os.path.join(self.path, to)).count()
        if n:
            self.meta["replaced"] = [*self.meta["replaced"], {"path": to, "version": self.meta["version"], "rows": n}]
        return n

    def _commit(self) -> None:
        paths = [self.meta["router"], self.meta["centers"], *[p["path"] for p in self.meta["parts"] + self.meta["replaced"]]]
        used = sorted({p.split("/")[0] for p in paths})
        kept, self.meta = {*used, *self.meta.get("used", [])}, self.meta | {"used": used}
        aside = os.path.join(self.path, "CURRENT.new")
        with open(aside, "w") as f:
            json.dump(self.meta, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(aside, os.path.join(self.path, "CURRENT"))
        folder = os.open(self.path, os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)
        # the version before stays for those who still read it
        for d in os.listdir(self.path):
            if d.startswith("v") and d not in kept:
                shutil.rmtree(os.path.join(self.path, d), ignore_errors=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str, verify: bool = False) -> Index:
        """verify: raise where files don't hold what was written (see `verify`)."""
        index = cls(spark, path)
        if verify:
            index.verify()
        return index

    def save(self, path: str) -> None:
        """Copies this version elsewhere, as one part."""
        copy = self._start(self.spark, path, {k: v for k, v in self.meta.items() if k in ("dim", "blocks", "step", "embedding")})
        copy._write(router=self.router, centers=self.centers)
        copy._add(self.vectors, self._rows())
        copy._commit()

    def _rows(self) -> int:
        return sum(p["rows"] for p in self.meta["parts"])

    def verify(self) -> None:
        """Raises where a part has other rows than when it was written, by their number and a sum of hashes."""
        for part in self.meta["parts"]:
            if self._sums(part) != {"rows": part["rows"], "sum": part["sum"]}:
                raise ValueError(f"{part['path']} doesn't hold what was written")

    def validate(self) -> None:
        """Raises where tables don't fit together: a centroid without shard, counts other than the live members, an id twice."""
        self.verify()
        n = self.centers.count()
        if self.router.count() != n or self.router.join(self.centers, "cid").count() != n:
            raise ValueError("router and centroids differ")
        live = self.vectors.where("not deleted").agg(F.count("*"), F.count_distinct("vec_id")).first()
        if self.centers.agg(F.sum("cnt")).first()[0] != live[0]:
            raise ValueError("counts don't add up to the live vectors")
        if live[0] != live[1]:
            raise ValueError("an id is there twice")

    def route(self, queries: DataFrame, mode: str, param: float) -> DataFrame:
        return routing.route(queries, self.router, mode, param, self.dim)

    def search(self, queries: DataFrame, k: int, mode: str = "NProbe", param: float = 2, exclude_self: bool = False, routes: DataFrame | None = None) -> DataFrame:
        """(qid, rank, vec_id, d); fewer than k rows where the shards visited hold fewer. routes: those of `route`, where they are there already."""
        routes = self.route(queries, mode, param) if routes is None else routes
        return routing.search(self.vectors, queries, routes, k, exclude_self)

    def exact(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        return nearest.exact_knn(self.vectors.where("not deleted"), queries, k, exclude_self=exclude_self)

    def insert(self, vectors: DataFrame) -> None:
        """Adds vectors as a part of their own; ids that live are deleted first (an upsert), so means stay right. Of rows of one id the least counts."""
        self._check(vectors)
        old = self.vectors
        with self._timed("place_s"):
            part = self._add(updates.once(routing.place(vectors, self.router, ("embedding",))), vectors.count())
        new, centers = self._part(part), self.centers
        ids = new.select("vec_id")
        # of the vectors there are only ids are read, and more of those that are replaced
        if n := self._replace(old.select("vec_id").join(F.broadcast(ids) if part["rows"] <= BROADCAST_IDS else ids, "vec_id", "left_semi").distinct()):
            gone = self.spark.read.schema("vec_id bigint").parquet(os.path.join(self.path, self.meta["replaced"][-1]["path"]))
            lost = old.where("not deleted").join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, "vec_id", "left_semi")
            centers = updates.centers_after_delete(centers, lost, self.dim)
        # the part is as new as the ids that it replaces, so its own rows count
        part["version"] = self.meta["version"]
        self._write(centers=updates.centers_after_insert(centers, new, self.dim))
        self._merge()
        self._commit()

    def _merge(self) -> None:
        """All parts into one where they, or the ranges of deleted ids, are many."""
        if len(self.meta["parts"]) > MAX_PARTS or len(self.meta["ranges"]) > MAX_RANGES:
            self._add(self.vectors, self._rows(), alone=True)

    def delete(self, start: int, end: int, strict: bool = False) -> None:
        """Deletes ids from start to before end. Unknown ids are passed over, or an error if strict. Only centroids and the range are written."""
        gone = self.vectors.where(~F.col("deleted") & F.col("vec_id").between(start, end - 1))
        if strict and (n := gone.count()) < end - start:
            raise ValueError(f"{end - start - n} ids to delete aren't in the index")
        self._write(centers=updates.centers_after_delete(self.centers, gone, self.dim))
        self.meta["ranges"] = [*self.meta["ranges"], [self.meta["version"], start, end]]
        self._merge()
        self._commit()

    def repartition(self, seed: int = 0, degree: int = graph.DEGREE) -> maintenance.Repartition:
        return maintenance.repartition(self.centers, self.router.select("cid", "pid"), self.blocks, seed, degree=degree)

    def rebuild(self, new: maintenance.Repartition, full: bool) -> int:
        """Routes by the live centroids and the new partition from here on; gives how many vectors moved. A delta rebuild writes only these."""
        old, rows = self.vectors, self._rows()
        began = time.perf_counter()
        self._write(router=self.centers.join(F.broadcast(new.parts), "cid").select("cid", "cv", "pid"))
        placed = maintenance.rebuild_moves(old, self.router)
        if full:
            part = self._add(placed.drop("from_pid"), rows, alone=True)
        else:
            part = self._add(placed.where("pid <> from_pid").drop("from_pid"), new.elements)
            self._replace(self._part(part))
            part["version"] = self.meta["version"]
        # ids and shards only, from what was written
        now = self._part(part).select("vec_id", "pid")
        was = old.where("not deleted").select("vec_id", F.col("pid").alias("from_pid")).join(F.broadcast(now) if part["rows"] <= BROADCAST_IDS else now, "vec_id")
        flows = was.where("pid <> from_pid").groupBy("from_pid", "pid").count().collect()  # shards squared at most
        moved = sum(n for *_, n in flows)
        self._commit()
        self.timings["rebuild_s"] = time.perf_counter() - began
        left = {r.pid: r.n for r in self.vectors.where("deleted").groupBy("pid").agg(F.count("*").alias("n")).collect()}
        self.report = [(p, sum(n for a, _, n in flows if a == p), sum(n for _, b, n in flows if b == p), left.get(p, 0)) for p in range(self.blocks)]
        return moved

    def maintain(self, step: int, operation: str, threshold: int, interval: int = maintenance.CHECK_INTERVAL, degree: int = graph.DEGREE) -> dict:
        """Checks, if it is time, and rebuilds if centroids moved or tombstones are many."""
        n = self.centers.count()
        none = {"rebuild": "none", "moved": 0, "movers": 0, "elements_moved": 0}
        if maintenance.decision(step, operation, n, threshold, n, 0, interval) == "none":
            return none
        new = self.repartition(degree=degree)
        self.timings |= new.timings
        worst = updates.tombstone_ratio(self.vectors).agg(F.max("ratio")).first()[0] or 0.0
        what = maintenance.decision(step, operation, new.moved, threshold, n, worst, interval)
        return none | {"rebuild": what, "moved": new.moved, "movers": self.rebuild(new, what == "full") if what != "none" else 0, "elements_moved": new.elements}

    def set_ef(self, ef: int) -> None:
        """How many candidates a graph's search would look at. It isn't kept with the index, and exact search finds the same whatever it is."""
        if ef < 1:
            raise ValueError("ef is at least 1")
        self.ef = ef

    def shard_sizes(self) -> DataFrame:
        return updates.shard_sizes(self.vectors)

    def counts(self) -> DataFrame:
        return updates.index_counts(self.vectors)

    def metrics(self) -> dict:
        """What building and rebuilding took, in seconds by phase, and the index's sizes."""
        return {"dim": self.dim, "blocks": self.blocks, "rows": self._rows(), "parts": len(self.meta["parts"]), **{k: round(v, 6) for k, v in self.timings.items()}}

    def write_metrics(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.metrics(), f, indent=1)
