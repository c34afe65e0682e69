"""What several operators of this subpackage need: shared storage, size-checked broadcasts, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where unset, a temporary one, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended; a mounted folder can still be emptied
            if path.startswith("file:"):
                shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)


atexit.register(_clean)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what `materialize` wrote for tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            delete_path(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes, else as it is (Spark then shuffles).

    rows: their number where it is known and no column is a string, which saves counting.
    """
    if rows is None:
        width = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
        rows, size = df.agg(F.count("*"), F.sum(sum(width[1:], width[0]).cast("bigint"))).first()
    else:
        size = 8 * rows * len(df.columns)
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph of edges (a, b): rows (node, component), component the least node.

    Alternates large-star and small-star steps, each one aggregation and one join on the node; each
    round is written to the shared folder, so lineage stays short. Nodes are of any orderable type;
    edges with a null end and loops are ignored, repeated edges count once.
    """
    edges = materialize(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = _signature(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        # large-star leaves only edges from the larger node a to the smaller b
        large = materialize(large, "large")
        release(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        edges = materialize(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        release(large)
        if (now := _signature(edges)) == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
