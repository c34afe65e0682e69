"""Inserts and deletes: the vectors' table and the running means of the centroids.

An index table has vec_id, embedding, cid (the centroid at insertion, which never changes), pid (the shard, which
rebuilds change) and deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import distance
from tessera.operators import routing


def _batch_sums(rows: DataFrame, dim: int) -> DataFrame:
    v = distance.doubles("embedding")
    return rows.groupBy("cid").agg(F.count("*").alias("k"), F.array(*[F.sum(v[i]) for i in range(dim)]).alias("s"))


def centers_after_insert(centers: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """(cid, cv, cnt): c = (n c + sum) / (n + k) for centroids that rows (cid, embedding) join; others stay. With n = 0 the sum alone counts."""
    joined = centers.join(_batch_sums(rows, dim), "cid", "left")
    mean = F.zip_with("cv", "s", lambda c, s: (c * F.col("cnt") + s) / (F.col("cnt") + F.col("k")))
    return joined.select("cid", F.when(F.col("k") > 0, mean).otherwise(F.col("cv")).alias("cv"), (F.col("cnt") + F.coalesce("k", F.lit(0))).alias("cnt"))


def centers_after_delete(centers: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """(cid, cv, cnt): c = (n c - sum) / (n - k); a centroid left without members keeps its position."""
    joined = centers.join(_batch_sums(rows, dim), "cid", "left")
    mean = F.zip_with("cv", "s", lambda c, s: (c * F.col("cnt") - s) / (F.col("cnt") - F.col("k")))
    return joined.select("cid", F.when(F.col("cnt") > F.col("k"), mean).otherwise(F.col("cv")).alias("cv"), F.greatest(F.col("cnt") - F.coalesce("k", F.lit(0)), F.lit(0)).alias("cnt"))


def once(rows: DataFrame) -> DataFrame:
    """rows with one row for each vec_id, the least of its rows. Only ids are shuffled where none is there twice."""
    again = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if again.isEmpty():
        return rows
    others = [c for c in rows.columns if c != "vec_id"]
    return rows.groupBy("vec_id").agg(F.min(F.struct(*others)).alias("row")).select("vec_id", *[F.col(f"row.{c}").alias(c) for c in others]).select(*rows.columns)


def insert_step(index: DataFrame, vectors: DataFrame, router: DataFrame) -> DataFrame:
    """The index with new vectors, placed by the router's snapshot; an id that is there is replaced, of several new rows of one id the least counts."""
    new = routing.place(once(vectors.select("vec_id", "embedding")), router, ("embedding",)).withColumn("deleted", F.lit(False))
    return index.join(new.select("vec_id"), "vec_id", "left_anti").select("vec_id", "embedding", "cid", "pid", "deleted").unionByName(new)


def delete_step(index: DataFrame, start: int, end: int, strict: bool = False) -> DataFrame:
    """The index with the ids from start to before end marked deleted. Unknown ids are passed over, or an error if strict."""
    if strict and (n := index.where(F.col("vec_id").between(start, end - 1) & ~F.col("deleted")).count()) < end - start:
        raise ValueError(f"{end - start - n} ids to delete aren't in the index")
    return index.withColumn("deleted", F.col("deleted") | F.col("vec_id").between(start, end - 1))


def unmark_deleted(index: DataFrame, start: int, end: int) -> DataFrame:
    return index.withColumn("deleted", F.col("deleted") & ~F.col("vec_id").between(start, end - 1))


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors with the rows of new in place of those of the same id; of several new rows of one id the least counts."""
    new = once(new)
    return vectors.join(new.select("vec_id"), "vec_id", "left_anti").select(*vectors.columns).unionByName(new.select(*vectors.columns))


def get_items(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors of the ids given."""
    return vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")


def index_counts(index: DataFrame) -> DataFrame:
    """(current, live): current counts tombstones too."""
    return index.agg(F.count("*").alias("current"), F.count_if(~F.col("deleted")).alias("live"))


def shard_sizes(index: DataFrame) -> DataFrame:
    """(pid, live)"""
    return index.groupBy("pid").agg(F.count_if(~F.col("deleted")).alias("live"))


def tombstone_ratio(index: DataFrame) -> DataFrame:
    """(pid, ratio): deleted rows over all."""
    return index.groupBy("pid").agg((F.count_if("deleted") / F.count("*")).alias("ratio"))


def partition_counts(placed: DataFrame) -> DataFrame:
    """(pid, n)"""
    return placed.groupBy("pid").agg(F.count("*").alias("n"))


def active_set(steps: DataFrame, vectors: DataFrame, step: int) -> DataFrame:
    """(vec_id) of the vectors that live after a step: those whose last operation is an insert. steps: step, operation, start, end."""
    done = F.broadcast(steps.where((F.col("step") <= step) & F.col("operation").isin("insert", "delete")))
    hit = vectors.select("vec_id").join(done, (F.col("vec_id") >= F.col("start")) & (F.col("vec_id") < F.col("end")))
    return hit.groupBy("vec_id").agg(F.max_by("operation", "step").alias("last")).where("last = 'insert'").select("vec_id")


def scaled_queries(queries: DataFrame, scale: float) -> DataFrame:
    """(qid, source, original): max(1, round(scale n)) queries that go round the given ones (numbered from 0 by qid)."""
    n = queries.count()
    wanted = max(1, int(n * scale + 0.5))
    numbered = queries.select(F.col("qid").alias("source"), (F.row_number().over(Window.orderBy("qid")) - 1).cast("bigint").alias("k"))  # a query batch
    many = queries.sparkSession.range(wanted).withColumn("k", F.col("id") % n)
    return many.join(F.broadcast(numbered), "k").select(F.col("id").alias("qid"), "source", (F.col("id") < n).alias("original"))


def repeated_queries(queries: DataFrame, scale: float) -> DataFrame:
    """(qid, qv): the queries as `scaled_queries` repeats them; the first round keeps its ids, others get ids below 0."""
    many = scaled_queries(queries, scale)
    return many.join(F.broadcast(queries.select(F.col("qid").alias("source"), "qv")), "source").select(F.when(F.col("original"), F.col("source")).otherwise(-1 - F.col("qid")).alias("qid"), "qv")


def search_scale(steps: DataFrame, fraction: float, n_queries: int) -> DataFrame:
    """(updates, searches, scale): how many times the queries make searches this fraction of all operations."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction is between 0 and 1")
    size = F.col("end") - F.col("start")
    counted = steps.agg(F.sum(F.when(F.col("operation").isin("insert", "delete"), size).otherwise(0)).alias("updates"), F.count_if(F.col("operation") == "search").alias("searches"))
    return counted.withColumn("scale", F.lit(fraction / (1 - fraction)) * F.col("updates") / (F.col("searches") * n_queries))


def resume_point(checkpoints: DataFrame) -> DataFrame:
    """(step, next_step): the last committed checkpoint and the step to go on with; from (step, committed)."""
    return checkpoints.where("committed").agg(F.max("step").alias("step")).select("step", (F.coalesce("step", F.lit(0)) + 1).alias("next_step"))
