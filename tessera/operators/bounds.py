"""Upper bounds of recall from the true neighbours: the best that any choice of shards could do."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbour_shares(truth: DataFrame, placed: DataFrame, k: int, blocks: int) -> DataFrame:
    """(qid, pid, n, r, cum): for each query and shard the true neighbours in it, shards ranked by them (then pid), and their running sum."""
    shards = truth.sparkSession.range(blocks).select(F.col("id").cast("int").alias("pid"))
    n = truth.where(F.col("rank") <= k).join(placed.select("vec_id", "pid"), "vec_id").groupBy("qid", "pid").agg(F.count("*").alias("n"))
    every = truth.select("qid").distinct().crossJoin(F.broadcast(shards)).join(n, ["qid", "pid"], "left").select("qid", "pid", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy("qid").orderBy(F.desc("n"), "pid")
    return every.withColumn("r", F.row_number().over(w)).withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def nprobe(shares: DataFrame, k: int, blocks: int) -> DataFrame:
    """(nprobe, activation, mean_recall, p5_recall, p95_recall) for each number of shards."""
    x = F.col("cum") / k
    out = shares.groupBy(F.col("r").alias("nprobe")).agg(F.avg(x).alias("mean_recall"), F.percentile(x, 0.05).alias("p5_recall"), F.percentile(x, 0.95).alias("p95_recall"))
    return out.select("nprobe", (F.col("nprobe") / blocks).alias("activation"), "mean_recall", "p5_recall", "p95_recall")


def recall_target(shares: DataFrame, k: int, blocks: int, targets: list[float]) -> DataFrame:
    """(target, mean_shards, mean_recall, p95_shards): the fewest shards that reach each target, all where none does. Compared in whole neighbours."""
    out = None
    for t in targets:
        needed = math.ceil(t * k - 1e-9)
        first = F.coalesce(F.min(F.when(F.col("cum") >= needed, F.col("r"))), F.lit(blocks))
        reached = F.coalesce(F.min(F.when(F.col("cum") >= needed, F.col("cum"))), F.max("cum"))
        per = shares.groupBy("qid").agg(first.alias("shards"), reached.alias("got"))
        row = per.agg(F.avg("shards").alias("mean_shards"), F.avg(F.col("got") / k).alias("mean_recall"), F.percentile("shards", 0.95).alias("p95_shards")).select(F.lit(float(t)).alias("target"), "mean_shards", "mean_recall", "p95_shards")
        out = row if out is None else out.unionAll(row)
    return out


def branching_factor(shares: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """(mean_shards, actual, best, gap, p5_gap, p95_gap): recall of the shards visited against that of as many best ones."""
    visited = routes.select("qid", "pid").distinct()
    width = visited.groupBy("qid").agg(F.count("*").alias("m"))
    got = shares.join(visited, ["qid", "pid"], "left_semi").groupBy("qid").agg((F.sum("n") / k).alias("actual"))
    best = shares.join(width, "qid").where("r = m").select("qid", "m", (F.col("cum") / k).alias("best"))
    both = best.join(got, "qid").withColumn("gap", F.col("best") - F.col("actual"))
    return both.agg(F.avg("m").alias("mean_shards"), F.avg("actual").alias("actual"), F.avg("best").alias("best"), F.avg("gap").alias("gap"), F.percentile("gap", 0.05).alias("p5_gap"), F.percentile("gap", 0.95).alias("p95_gap"))
