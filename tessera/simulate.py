"""Offline simulation: routing state after each step, its partitions, and the recall that routing could reach."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bounds, clustering, graph, maintenance, metrics, nearest, partitioner, routing, updates


def centers_by_step(vectors: DataFrame, steps: DataFrame, centers: DataFrame, dim: int) -> DataFrame:
    """(step, cid, cv, cnt) after every insert and delete. Members keep the centroid of their insertion; an emptied centroid goes to the origin."""
    rows = steps.where("operation in ('insert', 'delete')").orderBy("step").collect()
    assigned, out = None, None
    current = centers
    for r in rows:
        mine = (F.col("vec_id") >= r.start) & (F.col("vec_id") < r.end)
        if r.operation == "insert":
            new = nearest.assign(vectors.where(mine), current, ("embedding",)).select("vec_id", "cid", "embedding")
            assigned = new if assigned is None else assigned.unionAll(new)
        else:
            assigned = assigned.where(~mine)
        assigned = assigned.persist()
        # collected: the router's centroids, at most some 10,000 rows; this also cuts the lineage between steps
        state = clustering.centers_from_sums(assigned, centers, dim).toPandas().sort_values("cid")
        current = vectors.sparkSession.createDataFrame(list(zip(state["cid"].tolist(), [list(map(float, v)) for v in state["cv"]], state["cnt"].tolist(), strict=True)), "cid int, cv array<double>, cnt bigint")
        step = current.withColumn("step", F.lit(r.step))
        out = step if out is None else out.unionAll(step)
    return out.select("step", "cid", "cv", "cnt")


def partitions_by_step(states: DataFrame, blocks: int, degree: int = graph.DEGREE, weighted: bool = True, seed: int = 0) -> DataFrame:
    """(step, cid, pid, moved): each step's partition, made in parallel, then named one after the other to agree with the step before."""

    import numpy as np
    import pandas as pd

    from tessera.functions import kernels

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        x, ids = np.array(rows["cv"].tolist()), np.arange(len(rows))
        r, c, d = kernels.nearest(x, x, ids, min(degree, max(len(x) - 1, 1)), ids)
        if weighted:
            keep = np.sqrt(d) >= graph.MIN_DISTANCE
            r, c, w = r[keep], c[keep], 1 / np.sqrt(d[keep])
            w = np.maximum(1, np.rint(w / max(w.max(initial=0), 1e-300) * graph.WEIGHT_SCALE))
        else:
            pairs = np.unique(np.minimum(r, c) * len(x) + np.maximum(r, c))
            r, c, w = pairs // len(x), pairs % len(x), np.ones(len(pairs))
        block = partitioner.partition(len(x), r, c, blocks, seed, w, np.maximum(rows["cnt"].to_numpy(), 1) if weighted else None)
        return pd.DataFrame({"step": rows["step"], "cid": rows["cid"], "pid": block.astype("int32")})

    made = states.groupBy("step").applyInPandas(one, "step int, cid int, pid int").toPandas().sort_values(["step", "cid"])
    out, before = [], None
    for step, rows in made.groupby("step", sort=True):
        block, moved = rows["pid"].to_numpy(), 0
        if before is not None:
            block, moved = partitioner.relabel(block, before, blocks)
        before = block
        out += [(int(step), int(c), int(p), moved) for c, p in zip(rows["cid"], block, strict=True)]
    return states.sparkSession.createDataFrame(out, "step int, cid int, pid int, moved int")


def plan(states: DataFrame, parts: DataFrame, blocks: int, tau: float | None = None, rebuilds: bool = True) -> dict[int, tuple[int, float | None, bool]]:
    """For each step with a state: the step whose state routes, the drift that led to it, whether it is a new one.

    rebuilds: every step routes by its own state. Without, all route by the first. With tau, by the
    last one whose drift from the one before it was above tau.
    """
    named: dict[int, dict[int, int]] = {}
    for r in parts.join(states.select("step").distinct(), "step", "left_semi").select("step", "cid", "pid").collect():  # centroids times steps
        named.setdefault(r.step, {})[r.cid] = r.pid
    at = sorted(named)
    if tau is not None:
        return {s: (a, phi, did) for s, phi, did, a in maintenance.threshold_simulation([(s, named[s]) for s in at], blocks, tau)}
    return {s: (s if rebuilds else at[0], None, rebuilds or s == at[0]) for s in at}


def _router(states: DataFrame, parts: DataFrame, step: int) -> DataFrame:
    return states.where(F.col("step") == step).select("cid", "cv").join(F.broadcast(parts.where(F.col("step") == step).select("cid", "pid")), "cid")


def _truth(vectors: DataFrame, queries: DataFrame, steps: DataFrame, step: int, k: int, truth: dict[int, DataFrame] | None) -> tuple[DataFrame, DataFrame] | None:
    """(live vectors, true neighbours) after a step. truth: those by step, as files have them, which are of the search after an update: step + 1."""
    live = vectors.join(updates.active_set(steps, vectors, step), "vec_id", "left_semi")
    if truth is None:
        return live, nearest.exact_knn(live, queries, k)  # a query that is itself a vector isn't its own neighbour
    return (live, truth[step + 1]) if step + 1 in truth else None


def recall_by_step(vectors: DataFrame, queries: DataFrame, steps: DataFrame, states: DataFrame, parts: DataFrame, blocks: int, k: int, mode: str, param: float, dim: int, tau: float | None = None, rebuilds: bool = True, truth: dict[int, DataFrame] | None = None) -> list[dict]:
    """For each step with a state: recall, activation, load variation, queries by shard and time a query of routing among the vectors that live.

    Which state routes is as `plan` has it. truth: the true neighbours (qid, rank, vec_id) by step + 1; steps
    without them are passed over; None: they are computed.
    """
    out, n = [], queries.count()
    for s, (active, phi, did) in plan(states, parts, blocks, tau, rebuilds).items():
        if (given := _truth(vectors, queries, steps, s, k, truth)) is None:
            continue
        router, live, gt = _router(states, parts, active).persist(), given[0], given[1].persist()
        began = time.perf_counter()
        routes = routing.route(queries, router, mode, param, dim).persist()
        routes.count()
        seconds = time.perf_counter() - began
        loads = {r.pid: r.n for r in updates.partition_counts(routes).collect()}
        row = {
            "step": s, "mode": mode, "param": param, "active_step": active, "phi": phi, "did_rebuild": did,
            "recall": metrics.rerouted_recall(gt, live, router, routes, k).first().recall,
            "activation": metrics.activation(routes, blocks).first().activation,
            "cof": metrics.load_cof(routes, blocks).first().cof,
            "avg_parts": metrics.avg_parts_searched(routes, n).first().avg_parts,
            "queries_by_shard": [loads.get(p, 0) for p in range(blocks)], "query_time_s": seconds / max(n, 1),
        }
        if "prob" in routes.columns:
            ranked = metrics.mean_partition_ranking(routing.route(queries, router, mode, 1.0, dim), n).orderBy("rank").collect()  # shards
            row |= {"partition_ranking": [r.pid for r in ranked], "partition_probs": [r.prob for r in ranked]}
        out.append(row)
        for df in (router, gt, routes):
            df.unpersist()
    return out


def bounds_by_step(vectors: DataFrame, queries: DataFrame, steps: DataFrame, states: DataFrame, parts: DataFrame, blocks: int, k: int, targets: list[float], tau: float | None = None, rebuilds: bool = True, truth: dict[int, DataFrame] | None = None) -> tuple[list[dict], DataFrame | None]:
    """The best that any choice of shards could do at each step: rows by step, kind (NProbe, RecallTarget) and param with activation and recall.

    And each query's shards, best first: (step, qid, shards, shares). Neighbours are where the state that routes puts them.
    """
    rows, rankings = [], None
    for s, (active, _, _) in plan(states, parts, blocks, tau, rebuilds).items():
        if (given := _truth(vectors, queries, steps, s, k, truth)) is None:
            continue
        live, gt = given[0], given[1].persist()
        router = _router(states, parts, active)
        needed = live.join(gt.where(F.col("rank") <= k).select("vec_id").distinct(), "vec_id", "left_semi")
        shares = bounds.neighbour_shares(gt, routing.place(needed, router), k, blocks).persist()
        rows += [{"step": s, "active_step": active, "kind": "NProbe", "param": float(r.nprobe), "activation": r.activation, "recall": r.mean_recall} for r in bounds.nprobe(shares, k, blocks).orderBy("nprobe").collect()]
        rows += [{"step": s, "active_step": active, "kind": "RecallTarget", "param": r.target, "activation": r.mean_shards / blocks, "recall": r.mean_recall} for r in bounds.recall_target(shares, k, blocks, targets).orderBy("target").collect()]
        mine = shares.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "pid", "n"))).alias("x"))  # a query's shards
        mine = mine.select(F.lit(s).alias("step"), "qid", F.transform("x", lambda v: v["pid"]).alias("shards"), F.transform("x", lambda v: v["n"] / k).alias("shares"))
        rankings = mine if rankings is None else rankings.unionAll(mine)
        gt.unpersist()
    return rows, rankings
