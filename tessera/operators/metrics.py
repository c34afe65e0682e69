"""How well routing and search did, and how loads spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import routing


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(hits, queries, recall): results (qid, vec_id) that are among the first k of truth (qid, rank, vec_id), over queries times k."""
    gt = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    hits = gt.join(results.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    counted = hits.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.countDistinct("qid").alias("queries"))
    return counted.withColumn("recall", F.when(F.col("queries") > 0, F.col("hits") / (F.col("queries") * k)).otherwise(-1.0))


def theoretical_recall(truth: DataFrame, placed: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """(queries, recall): the share of true neighbours whose shard is visited; those not placed count as missed; over k even if truth is shorter."""
    gt = truth.where(F.col("rank") <= k).select("qid", "vec_id").join(placed.select("vec_id", "pid"), "vec_id", "left")
    hit = gt.join(routes.select("qid", "pid").distinct().withColumn("hit", F.lit(1)), ["qid", "pid"], "left")
    return hit.agg(F.countDistinct("qid").alias("queries"), (F.coalesce(F.sum("hit"), F.lit(0)) / (F.countDistinct("qid") * k)).alias("recall"))


def rerouted_recall(truth: DataFrame, vectors: DataFrame, router: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """theoretical_recall with each neighbour where the router would put it now."""
    needed = vectors.join(truth.where(F.col("rank") <= k).select("vec_id").distinct(), "vec_id", "left_semi")
    return theoretical_recall(truth, routing.place(needed, router), routes, k)


def avg_parts_searched(routes: DataFrame, n_queries: int) -> DataFrame:
    """(avg_parts)"""
    return routes.agg((F.count("*") / n_queries).alias("avg_parts"))


def activation(routes: DataFrame, blocks: int) -> DataFrame:
    """(activation): the mean share of shards that a query visits."""
    return routes.groupBy("qid").count().agg((F.avg("count") / blocks).alias("activation"))


def _loads(routes: DataFrame, blocks: int) -> DataFrame:
    shards = routes.sparkSession.range(blocks).select(F.col("id").cast("int").alias("pid"))
    return shards.join(routes.groupBy("pid").agg(F.count("*").alias("n")), "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("n"))


def load_cof(routes: DataFrame, blocks: int) -> DataFrame:
    """(cof): population deviation over mean of the queries per shard; 0 without queries."""
    return _loads(routes, blocks).agg(F.when(F.avg("n") > 0, F.stddev_pop("n") / F.avg("n")).otherwise(0.0).alias("cof"))


def load_skew(routes: DataFrame, blocks: int) -> DataFrame:
    """(skew, hot_pid): most over mean queries per shard, and the least shard that has the most."""
    hot = F.max(F.struct("n", (-F.col("pid")).alias("p")))
    return _loads(routes, blocks).agg(F.when(F.avg("n") > 0, F.max("n") / F.avg("n")).otherwise(0.0).alias("skew"), (-hot["p"]).alias("hot_pid"))


def hot_shard_summary(routes: DataFrame, blocks: int) -> DataFrame:
    """(mode, pid, load, times_hottest): over a mode's parameters the sum of load over mean, and how often a shard was the hottest. routes: mode, param, qid, pid."""
    shards = routes.sparkSession.range(blocks).select(F.col("id").cast("int").alias("pid"))
    runs = routes.select("mode", "param").distinct().crossJoin(F.broadcast(shards))
    n = runs.join(routes.groupBy("mode", "param", "pid").agg(F.count("*").alias("n")), ["mode", "param", "pid"], "left").select("mode", "param", "pid", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy("mode", "param")
    ranked = n.withColumn("multiple", F.col("n") / F.avg("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "pid")))
    return ranked.groupBy("mode", "pid").agg(F.sum("multiple").alias("load"), F.count_if(F.col("r") == 1).alias("times_hottest"))


def distance_spread(queries: DataFrame, router: DataFrame, centers: int = 50, most: int = 1000) -> DataFrame:
    """(measure, p5, p50, p95, mean) of the relative and absolute spread of distances to the nearest centroids, over the first queries; percentiles by lower index."""
    some = queries.orderBy("qid").limit(most)
    found = routing.nearest.closest_centers(some, router, centers).groupBy("qid").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    both = found.select(F.explode(F.array(F.struct(F.lit("relative").alias("measure"), ((F.col("d1") - F.col("d0")) / (F.col("d0") + 1e-10)).alias("x")), F.struct(F.lit("absolute").alias("measure"), (F.col("d1") - F.col("d0")).alias("x")))).alias("m")).select("m.*")
    listed = both.groupBy("measure").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.avg("x").alias("mean"))  # at most 1000 each
    at = lambda p: F.element_at("xs", (F.floor((F.size("xs") - 1) * F.lit(p)) + 1).cast("int"))
    return listed.select("measure", at(0.05).alias("p5"), at(0.5).alias("p50"), at(0.95).alias("p95"), "mean")


def mean_partition_ranking(probabilities: DataFrame, n_queries: int) -> DataFrame:
    """(pid, prob, rank): shards by their mean probability over all queries; absent ones count as 0."""
    mean = probabilities.groupBy("pid").agg((F.sum("prob") / n_queries).alias("prob"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("prob"), "pid")))  # a row for each shard
