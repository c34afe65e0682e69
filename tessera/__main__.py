"""Command line: python -m tessera static | dynamic | theory | oracle (see --help of each).

Vectors come from files in one of the binary formats or from Parquet with vec_id and embedding; queries
likewise; true neighbours from a ground-truth file.
"""

from __future__ import annotations

import argparse
import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import simulate, sweeps
from tessera.index import Index
from tessera.operators import bounds, nearest, routing
from tessera.sources import runbook, states, vecs
from tessera.streaming import replay


def _vectors(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    if os.path.splitext(path)[1].lower() in vecs.FORMATS:
        reader = spark.read.format("vecs")
        return (reader.option("rows", rows) if rows is not None else reader).load(path)
    return spark.read.parquet(path) if rows is None else spark.read.parquet(path).orderBy("vec_id").limit(rows)


def _queries(spark: SparkSession, path: str, rows: int | None) -> DataFrame:
    return _vectors(spark, path, rows).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def _truth(spark: SparkSession, base: str, path: str) -> DataFrame:
    kind = vecs.ground_truth_kind(base) if os.path.splitext(base)[1].lower() in vecs.FORMATS else "bin"
    return spark.read.format("groundtruth").option("kind", kind).load(path)


def _csv(path: str, rows: list[dict]) -> None:
    with open(path + ".new", "w", newline="") as f:
        out = csv.DictWriter(f, list(rows[0]) if rows else [])
        out.writeheader()
        out.writerows(rows)
    os.replace(path + ".new", path)


def static(spark: SparkSession, a: argparse.Namespace) -> None:
    """Builds an index and sweeps the routing parameters: recall, queries per second, load of each shard."""
    base, queries = _vectors(spark, a.base), _queries(spark, a.queries, a.n_queries)
    index = Index.build(base, os.path.join(a.out, "index"), a.centers, a.partitions, degree=2 * a.m)
    index.write_metrics(os.path.join(a.out, "build_metrics.json"))
    truth = _truth(spark, a.base, a.gt) if a.gt else nearest.exact_knn(base, queries, a.k, exclude_self=False)
    rows, loads = sweeps.search_sweep(index, queries, truth.persist(), a.k, _grid(a), a.runs)
    sweeps.write_sweep(rows, loads, a.partitions, os.path.join(a.out, "sweep"))


def dynamic(spark: SparkSession, a: argparse.Namespace) -> None:
    """Replays a runbook with searches, inserts, deletes and rebuilds; goes on from the last checkpoint."""
    base, queries = _vectors(spark, a.base), _queries(spark, a.queries, a.n_queries)
    steps = runbook.load(spark, a.runbook, a.key)
    at = os.path.join(a.out, "index")
    if a.init_state_dir and not os.path.exists(os.path.join(at, "CURRENT")) and not replay.latest_checkpoint(a.out):
        step = states.first_step(a.init_state_dir, a.init_partitions or a.init_state_dir) if a.init_state_step is None else a.init_state_step
        index = Index.from_state(base, at, states.read_state(spark, a.init_state_dir, step, a.init_partitions), a.partitions)
        index.meta["step"] = step
        index._commit()
    combos = [(m, p) for m, ps in _grid(a).items() for p in ps]
    run = replay.Replay(spark, base, queries, a.out, a.centers, a.partitions, a.threshold, a.k, combos, 2 * a.m, a.interval, a.checkpoint_every, a.strict, a.search_scale, a.search_fraction)
    replay.write_csv(run.run(steps), os.path.join(a.out, "results.csv"))


def _states(spark: SparkSession, folder: str, partitions: str, blocks: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(states, parts, number of shards) of all steps that have both, from the first."""
    first = states.first_step(folder, partitions)
    some = [s for s in states.steps(folder, "centers") if s >= first and os.path.exists(states.path_of(partitions, s, "partitions"))]
    rows, parts = None, None
    for s in some:
        c = states.read_centers(spark, folder, s)
        p, _ = states.read_partitions(spark, partitions, s, c.count())
        c, p = c.withColumn("step", F.lit(s)), p.withColumn("step", F.lit(s))
        rows, parts = (c, p) if rows is None else (rows.unionByName(c), parts.unionByName(p))
    return rows, parts, blocks or parts.agg(F.max("pid")).first()[0] + 1


def theory(spark: SparkSession, a: argparse.Namespace) -> None:
    """Recall that routing could reach at each step, and for the recall-target modes the best that any choice of shards could."""
    if a.no_rebuilds and a.threshold is not None:
        raise SystemExit("--threshold and --no-rebuilds exclude each other")
    base, queries = _vectors(spark, a.base), _queries(spark, a.queries, a.n_queries)
    steps = runbook.load(spark, a.runbook, a.key)
    rows, parts, blocks = _states(spark, a.states, a.states_partitions or a.states, None)
    truth = None
    if a.gt_dir:
        truth = {s: spark.read.format("groundtruth").option("kind", "bin").load(p) for s in range(1, steps.agg(F.max("step")).first()[0] + 2) if os.path.exists(p := os.path.join(a.gt_dir, f"step{s}.gt100"))}
    dim = nearest.Table(rows.where(F.col("step") == rows.agg(F.min("step")).first()[0]), "cid", "cv", nearest.MAX_CENTERS).dim
    given, out = (rows, parts, blocks, a.k), []
    for param in a.params or routing.DYNAMIC_GRID.get(a.mode, routing.DYNAMIC_GRID["RecallTarget"]):
        out += simulate.recall_by_step(base, queries, steps, *given, a.mode, param, dim, a.threshold, not a.no_rebuilds, truth)
    keys = list(dict.fromkeys(k for r in out for k in r))
    os.makedirs(a.out, exist_ok=True)
    _csv(os.path.join(a.out, f"theory_{a.mode}.csv"), [{k: r.get(k) for k in keys} for r in out])
    best, rankings = simulate.bounds_by_step(base, queries, steps, *given, a.params if a.params and a.mode.startswith("RecallTarget") else routing.DYNAMIC_GRID["RecallTarget"], a.threshold, not a.no_rebuilds, truth)
    _csv(os.path.join(a.out, "bounds.csv"), best)
    if a.per_query_rankings and rankings is not None:
        rankings.write.mode("overwrite").parquet(os.path.join(a.out, "per_query_rankings"))


def oracle(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best that any choice of shards of an index could do."""
    index = Index.load(spark, a.index)
    queries = _queries(spark, a.queries, a.n_queries)
    truth = _truth(spark, a.base, a.gt) if a.gt else index.exact(queries, a.k)
    truth = truth.join(F.broadcast(queries.select("qid")), "qid", "left_semi")
    shares = bounds.neighbour_shares(truth, index.vectors.where("not deleted"), a.k, index.blocks).persist()
    os.makedirs(a.out, exist_ok=True)
    _csv(os.path.join(a.out, "oracle_nprobe.csv"), [r.asDict() for r in bounds.nprobe(shares, a.k, index.blocks).orderBy("nprobe").collect()])
    _csv(os.path.join(a.out, "oracle_recall_target.csv"), [r.asDict() for r in bounds.recall_target(shares, a.k, index.blocks, routing.STATIC_GRID["RecallTarget"]).orderBy("target").collect()])
    branch = [{"branching_factor": b} | bounds.branching_factor(shares, index.route(queries, "BranchingFactor", b), a.k).first().asDict() for b in routing.STATIC_GRID["BranchingFactor"]]
    _csv(os.path.join(a.out, "oracle_branching_factor.csv"), branch)


def _grid(a: argparse.Namespace) -> dict[str, list[float]]:
    grid = routing.STATIC_GRID if a.command == "static" else routing.DYNAMIC_GRID
    if a.mode:
        return {a.mode: a.params or grid[a.mode]}
    return grid


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    modes = ["BranchingFactor", "NProbe", "RecallTarget", "RecallTargetExtended"]
    for f in (static, dynamic, theory, oracle):
        c = commands.add_parser(f.__name__, description=f.__doc__)
        c.set_defaults(run=f)
        c.add_argument("--base", required=f is not oracle, help="file of vectors")
        c.add_argument("--queries", required=True, help="file of queries")
        c.add_argument("--n-queries", type=int, default=10_000)
        c.add_argument("--out", required=True, help="folder for results")
        c.add_argument("--k", type=int, default=10)
        if f is not dynamic and f is not theory:
            c.add_argument("--gt", help="file of true neighbours; computed if not given")
        if f is oracle:
            c.add_argument("--index", required=True)
            continue
        c.add_argument("--mode", choices=modes, required=f is theory)
        c.add_argument("--params", nargs="+", type=float)
        if f is theory:
            c.add_argument("--states", required=True, help="folder of step_NNNNNN_centers.csv")
            c.add_argument("--states-partitions", help="folder of step_NNNNNN_partitions.csv")
            c.add_argument("--gt-dir", help="folder of stepN.gt100; true neighbours are computed if not given")
            c.add_argument("--no-rebuilds", action="store_true")
            c.add_argument("--threshold", type=float, help="rebuild where the drift is above it")
            c.add_argument("--per-query-rankings", action="store_true")
        else:
            c.add_argument("--partitions", type=int, default=10)
            c.add_argument("--centers", type=int, default=10_000)
            c.add_argument("--m", type=int, default=16, help="half the degree of the centroids' graph")
        if f is static:
            c.add_argument("--runs", type=int, default=sweeps.RUNS)
        else:
            c.add_argument("--runbook", required=True)
            c.add_argument("--key", required=True, help="dataset in the runbook")
        if f is dynamic:
            c.add_argument("--threshold", type=int, required=True, help="moved centroids that ask for a rebuild")
            c.add_argument("--interval", type=int, default=6)
            c.add_argument("--checkpoint-every", type=int, default=replay.CHECKPOINT_INTERVAL)
            c.add_argument("--strict", action="store_true", help="deleting an unknown id is an error")
            c.add_argument("--search-scale", type=float, default=1.0)
            c.add_argument("--search-fraction", type=float)
            c.add_argument("--init-state-dir")
            c.add_argument("--init-state-step", type=int)
            c.add_argument("--init-partitions")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    vecs.register(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
