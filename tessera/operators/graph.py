"""The proximity graph of centroids, its partition and how partitions compare."""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import nearest, partitioner

#: Neighbours of a centroid: twice the graph parameter M of 16.
DEGREE = 32
MIN_DISTANCE, WEIGHT_SCALE = 1e-4, 10_000


def knn_graph(centers: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(src, dst, d): the edges from each centroid to its nearest others; d is the squared distance."""
    queries = centers.select(F.col("cid").cast("bigint").alias("qid"), F.col("cv").alias("qv"))
    found = nearest.closest_centers(queries, centers, degree + 1).where("qid <> cid")
    r = F.row_number().over(Window.partitionBy("qid").orderBy("rn"))
    return found.withColumn("r", r).where(F.col("r") <= degree).select(F.col("qid").cast("int").alias("src"), F.col("cid").alias("dst"), "d")


def symmetrize(edges: DataFrame) -> DataFrame:
    """(src, dst): every edge in both directions, once, without loops."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def base_layer_edges(centers: DataFrame, edges: DataFrame, zero_counts: str = "all") -> DataFrame:
    """(src, dst, w) with Euclidean w at least MIN_DISTANCE. zero_counts: all; drop_edges or skip_nodes leaves out those at centroids without members."""
    if zero_counts not in ("all", "drop_edges", "skip_nodes"):
        raise ValueError(zero_counts)
    rows = edges.select("src", "dst", F.sqrt("d").alias("w")).where((F.col("w") >= MIN_DISTANCE) & ~F.isnan("w") & (F.col("w") < float("inf")))
    if zero_counts != "all":
        live = F.broadcast(centers.where("cnt > 0").select("cid"))
        for end in ("src", "dst"):
            rows = rows.join(live, F.col(end) == F.col("cid"), "left_semi")
    return rows


def edge_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): greatest inverse distance = WEIGHT_SCALE, at least 1; edges given both ways count in both. edges: src, dst, w."""
    top = edges.agg(F.max(1 / F.col("w")).alias("top"))
    weight = F.greatest(F.lit(1), F.round((1 / F.col("w")) / F.col("top") * WEIGHT_SCALE).cast("bigint"))
    return edges.crossJoin(F.broadcast(top)).select("src", "dst", weight.alias("weight"))


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(edges, cut, ratio): undirected edges of a symmetric graph, those between blocks, their share."""
    p = F.broadcast(parts.select("cid", "pid"))
    ends = edges.where("src < dst").join(p.toDF("src", "a"), "src").join(p.toDF("dst", "b"), "dst")
    return ends.agg(F.count("*").alias("edges"), F.count_if(F.col("a") != F.col("b")).alias("cut")).withColumn("ratio", F.when(F.col("edges") > 0, F.col("cut") / F.col("edges")).otherwise(0.0))


def balance(parts: DataFrame) -> DataFrame:
    """(pid, size, ratio): centroids of each block, and that over the average."""
    sizes = parts.groupBy("pid").agg(F.count("*").alias("size"))
    return sizes.withColumn("ratio", F.col("size") / F.avg("size").over(Window.partitionBy()))


def contingency(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_pid, old_pid, n): centroids by both partitions."""
    return new.select("cid", F.col("pid").alias("new_pid")).join(old.select("cid", F.col("pid").alias("old_pid")), "cid").groupBy("new_pid", "old_pid").agg(F.count("*").alias("n"))


def matching(new: DataFrame, old: DataFrame, blocks: int) -> dict[int, int]:
    """New label to old label, agreeing on the most centroids."""
    score = np.zeros((blocks, blocks))
    for r in contingency(new, old).collect():  # at most blocks squared rows
        score[r.new_pid, r.old_pid] = r.n
    return dict(enumerate(partitioner.match(score).tolist()))


def relabeled(new: DataFrame, old: DataFrame, blocks: int) -> DataFrame:
    """(cid, pid, old_pid): the new partition under the best matching labels."""
    names = matching(new, old, blocks)
    to = reduce(lambda c, kv: F.when(F.col("pid") == kv[0], kv[1]).otherwise(c), names.items(), F.col("pid"))
    return new.select("cid", to.cast("int").alias("pid")).join(old.select("cid", F.col("pid").alias("old_pid")), "cid")


def moved_centers(new: DataFrame, old: DataFrame, blocks: int) -> DataFrame:
    """(cid, old_pid, pid) of the centroids that change shard."""
    return relabeled(new, old, blocks).where("pid <> old_pid").select("cid", "old_pid", "pid")


def drift(new: DataFrame, old: DataFrame, blocks: int) -> DataFrame:
    """(moved, total, phi)"""
    out = relabeled(new, old, blocks).agg(F.count_if(F.col("pid") != F.col("old_pid")).alias("moved"), F.count("*").alias("total"))
    return out.withColumn("phi", F.when(F.col("total") > 0, F.col("moved") / F.col("total")).otherwise(0.0))


def partition(centers: DataFrame, blocks: int, degree: int = DEGREE, weighted: bool = False, seed: int = 0, timings: dict | None = None) -> DataFrame:
    """(cid, pid): balanced blocks of the centroids' graph. weighted: by inverse distance and counts. timings: gets the seconds of both phases."""
    began = time.perf_counter()
    edges = knn_graph(centers, min(degree, max(centers.count() - 1, 1)))
    graph = edge_weights(base_layer_edges(centers, edges)) if weighted else symmetrize(edges).where("src < dst").withColumn("weight", F.lit(1))
    rows, nodes = graph.toPandas().sort_values(["src", "dst"]), centers.select("cid", "cnt").toPandas().sort_values("cid")  # centroids: at most some 10,000
    at = {c: i for i, c in enumerate(nodes["cid"])}
    src, dst = (rows[c].map(at).to_numpy(np.int64) for c in ("src", "dst"))
    made = time.perf_counter()
    block = partitioner.partition(len(nodes), src, dst, blocks, seed, rows["weight"].to_numpy(float), np.maximum(nodes["cnt"].to_numpy(), 1) if weighted else None)
    if timings is not None:
        timings |= {"graph_s": made - began, "partition_s": time.perf_counter() - made}
    return centers.sparkSession.createDataFrame(list(zip(map(int, nodes["cid"]), map(int, block), strict=True)), "cid int, pid int")
