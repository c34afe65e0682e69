"""Experiments over grids of routing parameters."""

from __future__ import annotations

import csv
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.index import Index
from tessera.operators import bounds, metrics, routing

#: Timed passes for each setting, after one that isn't timed.
RUNS = 10


def combos(grid: dict[str, list[float]]) -> list[tuple[str, float]]:
    return [(mode, p) for mode, params in grid.items() for p in params]


def search_sweep(index: Index, queries: DataFrame, truth: DataFrame, k: int, grid: dict[str, list[float]] = routing.STATIC_GRID, runs: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """(mode, param, recall, qps, avg_parts, route_s, search_s), and loads (mode, param, qid, pid) for `metrics.hot_shard_summary`.

    Queries per second are those of the fastest of `runs` passes, routing included; route_s and search_s are of that pass.
    """
    spark, n = index.spark, queries.count()
    rows, loads = [], None
    for mode, param in combos(grid):
        routes = index.route(queries, mode, param).select("qid", "pid")
        mine = routes.select(F.lit(mode).alias("mode"), F.lit(float(param)).alias("param"), "qid", "pid")
        loads = mine if loads is None else loads.unionAll(mine)
        passes = []
        for i in range(runs + 1):
            began = time.perf_counter()
            held = routes.persist()
            held.count()
            routed = time.perf_counter()
            index.search(queries, k, routes=held).write.format("noop").mode("overwrite").save()
            done = time.perf_counter()
            if i < runs:
                held.unpersist(blocking=True)
            passes += [(done - began, routed - began, done - routed)] if i else []
        best = min(passes)
        found = index.search(queries, k, routes=routes)
        rows.append((mode, float(param), metrics.recall_at_k(found, truth, k).first().recall, n / best[0], metrics.avg_parts_searched(routes, n).first().avg_parts, *best[1:]))
        routes.unpersist()
    return spark.createDataFrame(rows, "mode string, param double, recall double, qps double, avg_parts double, route_s double, search_s double"), loads


def write_sweep(rows: DataFrame, loads: DataFrame, blocks: int, path: str) -> None:
    """A CSV file for each mode and parameter, and one beside it, .diag.csv, with each shard's queries and the times of routing and search."""
    os.makedirs(path, exist_ok=True)
    by: dict[tuple, dict[int, int]] = {}
    for r in loads.groupBy("mode", "param", "pid").count().collect():  # shards times combinations
        by.setdefault((r.mode, r.param), {})[r.pid] = r["count"]
    for r in rows.collect():
        at = os.path.join(path, f"{r.mode}_{r.param:g}")
        with open(at + ".csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["mode", "param", "recall@k", "qps", "avg_parts_searched"])
            out.writerow([r.mode, r.param, r.recall, r.qps, r.avg_parts])
        with open(at + ".diag.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["shard", "queries", "route_s", "search_s"])
            out.writerows([p, by.get((r.mode, r.param), {}).get(p, 0), r.route_s, r.search_s] for p in range(blocks))


def partitioning_quality(vectors: DataFrame, queries: DataFrame, truth: DataFrame, router: DataFrame, blocks: int, k: int, dim: int, grid: dict[str, list[float]] = routing.STATIC_GRID) -> DataFrame:
    """(mode, param, recall, activation, cof, bound): recall that routing could reach without any search, and the best for as many probes."""
    placed = routing.place(vectors, router).persist()
    shares = bounds.neighbour_shares(truth, placed, k, blocks).persist()
    best = {r.nprobe: r.mean_recall for r in bounds.nprobe(shares, k, blocks).collect()}
    rows = []
    for mode, param in combos(grid):
        routes = routing.route(queries, router, mode, param, dim).select("qid", "pid").persist()
        rows.append((mode, float(param), metrics.theoretical_recall(truth, placed, routes, k).first().recall, metrics.activation(routes, blocks).first().activation, metrics.load_cof(routes, blocks).first().cof, best.get(param) if mode == "NProbe" else None))
        routes.unpersist()
    for df in (placed, shares):
        df.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "mode string, param double, recall double, activation double, cof double, bound double")
