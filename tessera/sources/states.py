"""Step states as CSV files in a folder: centroids, counts, labels, edges and partitions of each step.

    step_000012_centers.csv        a centroid a line
    step_000012_center_counts.csv  its members
    step_000012_labels.csv         the centroid of each vector inserted up to then, in the order of ids
    step_000012_base_layer.csv     src,dst,distance
    step_000012_partitions.csv     the shard of each centroid, then how many centroids moved
"""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("centers", "center_counts", "labels", "base_layer", "partitions")


def path_of(folder: str, step: int, kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"no state file {kind}")
    return os.path.join(folder, f"step_{step:06d}_{kind}.csv")


def steps(folder: str, kind: str) -> list[int]:
    """The steps that have such a file."""
    found = [re.fullmatch(rf"step_(\d+)_{kind}\.csv", name) for name in os.listdir(folder)]
    return sorted(int(m[1]) for m in found if m)


def first_step(centers_folder: str, partitions_folder: str) -> int:
    """The first step with both centroids and a partition."""
    both = set(steps(centers_folder, "centers")) & set(steps(partitions_folder, "partitions"))
    if not both:
        raise FileNotFoundError(f"no step has centroids in {centers_folder} and a partition in {partitions_folder}")
    return min(both)


def _put(path: str, lines) -> None:
    with open(path + ".new", "w") as f:
        f.writelines(f"{line}\n" for line in lines)
    os.replace(path + ".new", path)


def write_centers(centers: DataFrame, folder: str, step: int) -> None:
    """centers: (cid, cv, cnt), at most some 10,000 rows, cid from 0."""
    rows = centers.select("cid", "cv", "cnt").orderBy("cid").collect()
    _put(path_of(folder, step, "centers"), (",".join(f"{x:.18e}" for x in r.cv) for r in rows))
    _put(path_of(folder, step, "center_counts"), (r.cnt for r in rows))


def write_partitions(parts: DataFrame, folder: str, step: int, moved: int = 0) -> None:
    """parts: (cid, pid), cid from 0."""
    rows = parts.select("cid", "pid").orderBy("cid").collect()
    _put(path_of(folder, step, "partitions"), [*(r.pid for r in rows), moved])


def write_edges(edges: DataFrame, folder: str, step: int) -> None:
    """edges: (src, dst, w) of the centroids' graph."""
    _put(path_of(folder, step, "base_layer"), (f"{r.src},{r.dst},{r.w:.18e}" for r in edges.select("src", "dst", "w").orderBy("src", "dst").collect()))


def write_labels(assigned: DataFrame, folder: str, step: int) -> None:
    """assigned: (vec_id, cid), a line for each in the order of ids; written part by part through the driver."""
    _put(path_of(folder, step, "labels"), (r.cid for r in assigned.select("vec_id", "cid").orderBy("vec_id").toLocalIterator()))


def read_centers(spark: SparkSession, folder: str, step: int) -> DataFrame:
    """(cid, cv, cnt); an error where lines don't agree in length or number."""
    with open(path_of(folder, step, "centers")) as f:
        rows = [[float(x) for x in line.split(",")] for line in f if line.strip()]
    if len({len(r) for r in rows}) > 1:
        raise ValueError(f"centroids of several dimensions at step {step}")
    counts = [0] * len(rows)
    if os.path.exists(at := path_of(folder, step, "center_counts")):
        with open(at) as f:
            counts = [int(line) for line in f if line.strip()]
    if len(counts) != len(rows):
        raise ValueError(f"{len(rows)} centroids but {len(counts)} counts at step {step}")
    return spark.createDataFrame(list(zip(range(len(rows)), rows, counts, strict=True)), "cid int, cv array<double>, cnt bigint")


def read_partitions(spark: SparkSession, folder: str, step: int, centers: int | None = None) -> tuple[DataFrame, int]:
    """((cid, pid), moved). centers: how many centroids there must be."""
    with open(path_of(folder, step, "partitions")) as f:
        *pids, moved = [int(line) for line in f if line.strip()]
    if centers is not None and len(pids) != centers:
        raise ValueError(f"{centers} centroids but {len(pids)} partition entries at step {step}")
    return spark.createDataFrame(list(enumerate(pids)), "cid int, pid int"), moved


def read_edges(spark: SparkSession, folder: str, step: int) -> DataFrame:
    return spark.read.schema("src int, dst int, w double").csv(path_of(folder, step, "base_layer"))


def read_labels(spark: SparkSession, folder: str, step: int, start: int = 0) -> DataFrame:
    """(vec_id, cid): ids count lines from `start`. The file is read in parallel: a line's number is that within its block plus the lines of the blocks before."""
    lines = spark.read.text(path_of(folder, step, "labels")).select(F.col("value").cast("int").alias("cid"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = sorted(lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect())
    before = np.concatenate(([0], np.cumsum([b.n for b in blocks]))).tolist()
    offsets = spark.createDataFrame([(b.block, start + n - b.first) for b, n in zip(blocks, before, strict=False)] or [(0, 0)], "block bigint, shift bigint")
    return lines.join(F.broadcast(offsets), "block").select((F.col("at") + F.col("shift")).alias("vec_id"), "cid")


def read_state(spark: SparkSession, folder: str, step: int, partitions_folder: str | None = None) -> dict[str, DataFrame]:
    """centers, router (cid, cv, pid) and labels of a step, for `Index.from_state`; an error where they don't fit together."""
    centers = read_centers(spark, folder, step)
    n = centers.count()
    parts, _ = read_partitions(spark, partitions_folder or folder, step, n)
    labels = read_labels(spark, folder, step)
    wrong = labels.where(F.col("cid").isNull() | ~F.col("cid").between(0, n - 1)).limit(1).collect()
    if wrong:
        raise ValueError(f"label {wrong[0].cid} of vector {wrong[0].vec_id} is no centroid")
    return {"centers": centers, "router": centers.select("cid", "cv").join(F.broadcast(parts), "cid"), "labels": labels}
