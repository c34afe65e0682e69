"""Routing: which shards a query visits, in order.

All modes start from `closest_centers` of the router's snapshot of the centroids, joined to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import nearest

#: Centroids that the recall-target modes look at; neighbours of the density estimate.
RT_CENTERS, KL_NEIGHBORS = 50, 3


def _ranked(queries: DataFrame, router: DataFrame, n: int) -> DataFrame:
    """(qid, rn, cid, d, pid)"""
    return nearest.closest_centers(queries, router, n, shard=True)


def first_seen(ranked: DataFrame) -> DataFrame:
    """(qid, pid, ord): shards by their nearest centroid, from 1."""
    return _in_order(ranked.groupBy("qid", "pid").agg(F.min("rn").alias("rn")))


def _in_order(once: DataFrame) -> DataFrame:
    return once.select("qid", "pid", F.row_number().over(Window.partitionBy("qid").orderBy("rn")).alias("ord"))


def branching_factor(queries: DataFrame, router: DataFrame, b: int) -> DataFrame:
    """(qid, pid, ord): the shards of the b nearest centroids."""
    return first_seen(_ranked(queries, router, b))


def nprobe(queries: DataFrame, router: DataFrame, p: int) -> DataFrame:
    """(qid, pid, ord): the first p distinct shards met from near to far."""
    return _in_order(nearest.first_by_shard(queries, router, p)).where(F.col("ord") <= p)


def _summed(scored: DataFrame) -> DataFrame:
    """scored (qid, pid, prob) with ord, by falling probability, and before, the sum of those before."""
    w = Window.partitionBy("qid").orderBy(F.desc("prob"), "pid")
    before = F.coalesce(F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return scored.withColumn("before", before).withColumn("ord", F.row_number().over(w))


def _reached(summed: DataFrame, target) -> DataFrame:
    # the first shard is always visited
    return summed.where((F.col("ord") == 1) | ((F.col("before") < target) & (F.col("prob") > 0)))


def _until(scored: DataFrame, target: float) -> DataFrame:
    """(qid, pid, ord, prob): shards by falling probability until their sum reaches the target, that one included."""
    return _reached(_summed(scored), min(max(target, 0.0), 1.0)).select("qid", "pid", "ord", "prob")


def _shard_probabilities(queries: DataFrame, router: DataFrame, centers: int = RT_CENTERS) -> DataFrame:
    """(qid, pid, prob): shards weighted by centroids times exp(-d / d of the nearest), summed over the nearest centroids."""
    sizes = F.broadcast(router.groupBy("pid").agg(F.count("*").alias("size")))
    ranked = _ranked(queries, router, centers).join(sizes, "pid")
    d0 = F.min("d").over(Window.partitionBy("qid"))
    scored = ranked.withColumn("s", F.col("size") * F.exp(-F.col("d") / (d0 + 1e-10))).groupBy("qid", "pid").agg(F.sum("s").alias("score"))
    whole = F.sum("score").over(Window.partitionBy("qid"))
    return scored.select("qid", "pid", F.when(whole > 0, F.col("score") / whole).otherwise(0.0).alias("prob"))


def recall_target(queries: DataFrame, router: DataFrame, target: float, centers: int = RT_CENTERS) -> DataFrame:
    """(qid, pid, ord, prob): the likeliest shards until their probabilities reach the target."""
    return _until(_shard_probabilities(queries, router, centers), target)


def recall_target_extended(queries: DataFrame, router: DataFrame, target: float, dim: int, centers: int = RT_CENTERS, neighbors: int = KL_NEIGHBORS) -> DataFrame:
    """(qid, pid, ord, prob): shards weighted by a nearest-neighbour density estimate, log k - dim log(distance of the k-th)."""
    ranked = _ranked(queries, router, centers)
    w = Window.partitionBy("qid", "pid").orderBy("rn")
    near = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= neighbors)
    density = near.groupBy("qid", "pid").agg(F.max("r").alias("k"), F.max("d").alias("d"))
    density = density.withColumn("density", F.log(F.col("k").cast("double")) - dim * F.log(F.greatest(F.sqrt("d"), F.lit(1e-10))))
    q = Window.partitionBy("qid")
    e = F.exp(F.col("density") - F.max("density").over(q))
    return _until(density.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(q)), target)


def route(queries: DataFrame, router: DataFrame, mode: str, param: float, dim: int | None = None) -> DataFrame:
    """Routing by the mode's name."""
    if mode == "BranchingFactor":
        return branching_factor(queries, router, int(param))
    if mode == "NProbe":
        return nprobe(queries, router, int(param))
    if mode == "RecallTarget":
        return recall_target(queries, router, param)
    if mode == "RecallTargetExtended":
        return recall_target_extended(queries, router, param, dim)
    raise ValueError(f"no routing mode {mode}")


#: The grids of parameters that sweeps go through.
STATIC_GRID = {"BranchingFactor": [1, 2, *range(5, 31, 5), 40, 60, 80, 100], "NProbe": [*range(1, 10)], "RecallTarget": [x / 100 for x in (60, 70, 75, 80, 85, 90, 95, 97, 98, 99)]}
DYNAMIC_GRID = {"BranchingFactor": [*range(20, 31, 5), *range(40, 61, 10), 80], "NProbe": [*range(1, 10)], "RecallTarget": [x / 100 for x in (85, 90, 95, 97, 98, 99)]}


def sweep(queries: DataFrame, router: DataFrame, bs: list[int], ps: list[int], targets: list[float] = ()) -> DataFrame:
    """(mode, param, qid, pid) for several parameters at once: one pass over centroids serves each kind of mode."""
    once = nearest.first_by_shard(queries, router, max(ps, default=1), max(bs, default=1)).withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("rn")))
    grid = [F.struct(F.lit("BranchingFactor").alias("mode"), F.lit(float(b)).alias("param"), (F.col("rn") <= b).alias("in")) for b in bs]
    grid += [F.struct(F.lit("NProbe").alias("mode"), F.lit(float(p)).alias("param"), (F.col("ord") <= p).alias("in")) for p in ps]
    out = once.select("qid", "pid", F.explode(F.array(*grid)).alias("g")).where("g.in").select("g.mode", "g.param", "qid", "pid")
    if targets:
        scored = _summed(_shard_probabilities(queries, router))
        wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("param")
        out = out.unionAll(_reached(scored.select("*", wanted), F.least(F.greatest("param", F.lit(0.0)), F.lit(1.0))).select(F.lit("RecallTarget").alias("mode"), "param", "qid", "pid"))
    return out


def place(vectors: DataFrame, router: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, cid, pid) and the columns to keep: the shard of each usable vector's nearest centroid. One pass, no shuffle, no join."""
    return nearest.assign(vectors, router, keep, shard=True).select("vec_id", "cid", "pid", *keep)


def placement_of(ids: DataFrame, placed: DataFrame) -> DataFrame:
    """(vec_id, pid) of the ids that are in the index."""
    return placed.join(ids.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "pid")


def search(placed: DataFrame, queries: DataFrame, routes: DataFrame, k: int, exclude_self: bool = False, router: DataFrame | None = None) -> DataFrame:
    """(qid, rank, vec_id, d): the k nearest in the shards that routes give. placed: vec_id, embedding, pid and maybe deleted; with a router pid isn't needed, vectors are placed as they are searched."""
    live = placed.where(~F.col("deleted")) if "deleted" in placed.columns else placed
    return nearest.topk(nearest.scan_topk(live, queries, k, routes, exclude_self, router), k)


def local_topk(placed: DataFrame, queries: DataFrame, routes: DataFrame, k: int, exclude_self: bool = False, router: DataFrame | None = None) -> DataFrame:
    """(qid, pid, rank, vec_id, d): the k nearest within each shard visited. placed, router: as for `search`."""
    found = nearest.scan_topk(placed, queries, k, routes, exclude_self, router)
    rank = F.row_number().over(Window.partitionBy("qid", "pid").orderBy("d", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "pid", "rank", "vec_id", "d")
