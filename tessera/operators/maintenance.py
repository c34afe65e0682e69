"""Keeping partitions fit: when to rebuild, what moves."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, routing

CHECK_INTERVAL, TOMBSTONE_LIMIT = 6, 0.5
NONE, FULL, PARTIAL = 0, 1, 2


@dataclass
class Repartition:
    """A new partition under matching labels, how many centroids it moves and the members that these count, and seconds by phase."""

    parts: DataFrame
    moved: int
    total: int
    elements: int = 0
    timings: dict = field(default_factory=dict)

    @property
    def phi(self) -> float:
        return self.moved / max(self.total, 1)


def repartition(live: DataFrame, old: DataFrame, blocks: int, seed: int = 0, weighted: bool = False, degree: int = graph.DEGREE) -> Repartition:
    """Graph of the live centroids, its partition, matched with the old one."""
    timings: dict[str, float] = {}
    made = graph.partition(live, blocks, degree, weighted, seed, timings)
    began = time.perf_counter()
    named = graph.relabeled(made, old, blocks).join(F.broadcast(live.select("cid", "cnt")), "cid").collect()  # centroids
    timings["relabel_s"] = time.perf_counter() - began
    parts = live.sparkSession.createDataFrame([(r.cid, r.pid) for r in named], "cid int, pid int")
    gone = [r for r in named if r.pid != r.old_pid]
    return Repartition(parts, len(gone), len(named), sum(r.cnt or 0 for r in gone), timings)


def need_rebuild(moved: int, full: int, partial: int, n_centers: int) -> int:
    """FULL, PARTIAL or NONE; a threshold of all centroids or more disables both."""
    if full >= n_centers or partial >= n_centers or (moved < full and moved < partial):
        return NONE
    return FULL if moved >= full else PARTIAL


def elements_moved(moved: DataFrame, centers: DataFrame) -> DataFrame:
    """(centers_moved, elements_moved): centroids that change shard, and members that they count."""
    return moved.join(centers.select("cid", "cnt"), "cid").agg(F.count("*").alias("centers_moved"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("elements_moved"))


def decision(step: int, operation: str, moved: int, threshold: int, n_centers: int, tombstones: float, interval: int = CHECK_INTERVAL) -> str:
    """none, delta or full: checked every so many steps, after updates only; many tombstones ask for a full rebuild."""
    if step % interval or operation not in ("insert", "delete") or threshold >= n_centers:
        return "none"
    if tombstones >= TOMBSTONE_LIMIT:
        return "full"
    return "delta" if moved >= threshold else "none"


def decisions(steps: DataFrame, threshold: int, n_centers: int, interval: int = CHECK_INTERVAL) -> DataFrame:
    """(step, decision) for rows (step, operation, moved, tombstones)."""
    checked = (F.col("step") % interval == 0) & F.col("operation").isin("insert", "delete") & F.lit(threshold < n_centers)
    return steps.select("step", F.when(~checked, "none").when(F.col("tombstones") >= TOMBSTONE_LIMIT, "full").when(F.col("moved") >= threshold, "delta").otherwise("none").alias("decision"))


def rebuild_full(index: DataFrame, router: DataFrame) -> DataFrame:
    """Every live vector goes where the new router puts it; tombstones go; the centroid at insertion stays."""
    live = index.where(~F.col("deleted")).select("vec_id", "embedding", F.col("cid").alias("first_cid"), "deleted")
    placed = routing.place(live, router, ("embedding", "first_cid", "deleted"))
    return placed.select("vec_id", "embedding", F.col("first_cid").alias("cid"), "pid", "deleted")


def rebuild_moves(index: DataFrame, router: DataFrame) -> DataFrame:
    """(vec_id, embedding, cid, pid, from_pid): the live vectors with the shard that the router gives them and the one where they are."""
    live = index.where(~F.col("deleted")).select("vec_id", "embedding", F.col("cid").alias("first_cid"), F.col("pid").alias("from_pid"))
    return routing.place(live, router, ("embedding", "first_cid", "from_pid")).select("vec_id", "embedding", F.col("first_cid").alias("cid"), "pid", "from_pid")


def delta_movers(index: DataFrame, router: DataFrame) -> DataFrame:
    """(vec_id, from_pid, to_pid) of the live vectors that change shard."""
    live = index.where(~F.col("deleted")).select("vec_id", "embedding", F.col("pid").alias("from_pid"))
    return routing.place(live, router, ("from_pid",)).select("vec_id", "from_pid", F.col("pid").alias("to_pid")).where("from_pid <> to_pid")


def rebuild_delta(index: DataFrame, movers: DataFrame) -> DataFrame:
    """The index after only the movers changed place."""
    to = movers.select("vec_id", "to_pid")
    return index.join(to, "vec_id", "left").withColumn("pid", F.coalesce("to_pid", "pid")).select("vec_id", "embedding", "cid", "pid", "deleted")


def threshold_simulation(partitions: list[tuple[int, dict[int, int]]], blocks: int, tau: float) -> list[tuple[int, float, bool, int]]:
    """(step, phi, rebuilt, active step) for partitions by step: a step whose drift from the active one is above tau takes its place."""
    import numpy as np

    from tessera.operators import partitioner

    out, active = [], None
    for step, parts in partitions:
        block = np.array([parts[c] for c in sorted(parts)])
        if active is None:
            active = (step, block)
            out.append((step, 0.0, False, step))
            continue
        phi = partitioner.drift(block, active[1], blocks)
        if phi > tau:
            active = (step, block)
        out.append((step, phi, phi > tau, active[0]))
    return out
