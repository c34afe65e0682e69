"""The engine's queries over the shared tables, each with the SQL that gives the same rows.

Fixtures, the same in both: vectors are the embeddings moved towards the vector of their label, which
gives them clusters; queries are ids below 50; centroids ids below 40; the shard of a centroid is its
id modulo 4; the runbook is RUNBOOK. Floats are rounded to 6 decimals.
"""

from __future__ import annotations

import json
import math
import os
import shutil
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import simulate, storage
from tessera.functions import distance
from tessera.index import Index
from tessera.operators import bounds, clustering, graph, maintenance, metrics, nearest, partitioner, routing, updates
from tessera.sources import runbook, states, vecs
from tessera.streaming import replay

DIM, CENTERS, BLOCKS, K, DEGREE = 64, 40, 4, 10, 8
RUNBOOK = [(1, "insert", 0, 300), (2, "search", None, None), (3, "delete", 50, 120), (4, "insert", 300, 400), (5, "search", None, None), (6, "delete", 0, 30), (7, "search", None, None), (8, "insert", 400, 500), (9, "search", None, None)]


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


class Fixtures:
    """The fixtures as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        base = self.raw.select("vec_id", "label", distance.doubles("embedding").alias("e"))
        towards = F.broadcast(base.where("vec_id < 10").select(F.col("vec_id").alias("label"), F.col("e").alias("t")))
        self.vectors = base.join(towards, "label").select("vec_id", "label", F.zip_with("e", "t", lambda x, y: x + y).alias("embedding"))
        self.queries = self.vectors.where("vec_id < 50").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
        self.router = self.centroids(0)
        self.steps = spark.createDataFrame(RUNBOOK, "step int, operation string, start bigint, end bigint")

    def centroids(self, first: int) -> DataFrame:
        rows = self.vectors.where(F.col("vec_id").between(first, first + CENTERS - 1))
        cid = (F.col("vec_id") - first).cast("int")
        return rows.select(cid.alias("cid"), F.col("embedding").alias("cv"), (cid % BLOCKS).alias("pid"), F.lit(0).cast("bigint").alias("cnt"))

    def placed(self) -> DataFrame:
        return routing.place(self.vectors, self.router, ("label", "embedding"))

    def index(self) -> DataFrame:
        return self.placed().select("vec_id", "embedding", "cid", "pid", F.col("vec_id").between(50, 119).alias("deleted"))

    def counted(self) -> DataFrame:
        """The centroids with the members that they have among ids below 300."""
        n = self.placed().where("vec_id < 300").groupBy("cid").agg(F.count("*").alias("n"))
        return self.router.join(n, "cid", "left").select("cid", "cv", F.coalesce("n", F.lit(0)).alias("cnt"))

    def truth(self) -> DataFrame:
        return nearest.exact_knn(self.vectors, self.queries, K)

    def nprobe(self, p: int = 2) -> DataFrame:
        return routing.nprobe(self.queries, self.router, p)

    def graph(self) -> DataFrame:
        return graph.knn_graph(self.router, DEGREE)

    def parts(self) -> DataFrame:
        return self.router.select("cid", "pid")

    def other_parts(self) -> DataFrame:
        return self.router.select("cid", ((F.col("cid") + 1 + F.floor(F.col("cid") / 13)) % BLOCKS).cast("int").alias("pid"))

    def shares(self) -> DataFrame:
        return bounds.neighbour_shares(self.truth(), self.placed(), K, BLOCKS)


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


#: The fixtures in SQL, in an order in which each needs only those before it.
CTES = {
    "raw": "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings",
    "v": "SELECT a.vec_id, a.label, list_transform(list_zip(a.e, b.e), lambda z: z[1] + z[2]) AS e FROM raw a JOIN raw b ON b.vec_id = a.label",
    "q": "SELECT vec_id AS qid, e AS qe FROM v WHERE vec_id < 50",
    "c": f"SELECT CAST(vec_id AS INTEGER) AS cid, e AS ce, CAST(vec_id % {BLOCKS} AS INTEGER) AS pid FROM v WHERE vec_id < {CENTERS}",
    "a": f"SELECT vec_id, label, e, cid, pid, d FROM (SELECT vec_id, label, e, cid, pid, {_d2('e', 'ce')} AS d FROM v, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1",
    "c2": f"SELECT CAST(vec_id - 100 AS INTEGER) AS cid, e AS ce, CAST(vec_id % {BLOCKS} AS INTEGER) AS pid FROM v WHERE vec_id BETWEEN 100 AND {99 + CENTERS}",
    "a2": f"SELECT vec_id, cid, pid FROM (SELECT vec_id, cid, pid, {_d2('e', 'ce')} AS d FROM v, c2) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1",
    "idx": "SELECT vec_id, e, cid, pid, vec_id BETWEEN 50 AND 119 AS deleted FROM a",
    "counted": "SELECT c.cid, any_value(c.ce) AS ce, count(a.vec_id) AS cnt FROM c LEFT JOIN a ON a.cid = c.cid AND a.vec_id < 300 GROUP BY c.cid",
    "qc": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, cid) AS rn FROM (SELECT qid, cid, pid, {_d2('qe', 'ce')} AS d FROM q, c)",
    "once": "SELECT qid, pid, min(rn) AS rn FROM qc GROUP BY qid, pid",
    "seen": "SELECT qid, pid, rn, CAST(row_number() OVER (PARTITION BY qid ORDER BY rn) AS INTEGER) AS ord FROM once",
    "np": "SELECT qid, pid, ord FROM seen WHERE ord <= 2",
    "bf": "SELECT qid, pid, CAST(row_number() OVER (PARTITION BY qid ORDER BY min(rn)) AS INTEGER) AS ord FROM qc WHERE rn <= 4 GROUP BY qid, pid",
    "sizes": "SELECT pid, count(*) AS size FROM c GROUP BY pid",
    "rt_score": "SELECT qid, pid, sum(size * exp(-d / (d0 + 1e-10))) AS score FROM (SELECT *, min(d) OVER (PARTITION BY qid) AS d0 FROM qc) JOIN sizes USING (pid) WHERE rn <= 50 GROUP BY qid, pid",
    "rt_prob": "SELECT qid, pid, score / sum(score) OVER (PARTITION BY qid) AS prob FROM rt_score",
    "rt_cum": "SELECT *, CAST(row_number() OVER w AS INTEGER) AS ord, coalesce(sum(prob) OVER (PARTITION BY qid ORDER BY prob DESC, pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rt_prob WINDOW w AS (PARTITION BY qid ORDER BY prob DESC, pid)",
    "rt": "SELECT qid, pid, ord, prob FROM rt_cum WHERE ord = 1 OR (before < 0.9 AND prob > 0)",
    "pairs": f"SELECT qid, vec_id, label, {_d2('qe', 'e')} AS d FROM q, v WHERE qid <> vec_id",
    "gt": f"SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, d FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) <= {K}",
    "found": f"SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY pairs.d, vec_id) AS INTEGER) AS rank, vec_id, pairs.d FROM pairs JOIN a USING (vec_id) JOIN np USING (qid, pid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pairs.d, vec_id) <= {K}",
    "knn": f"SELECT src, dst, d, rn FROM (SELECT x.cid AS src, y.cid AS dst, {_d2('x.ce', 'y.ce')} AS d FROM c x, c y WHERE x.cid <> y.cid) QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= {DEGREE}".replace("d, rn FROM", "d FROM"),
    "sym": "SELECT src, dst FROM knn UNION SELECT dst, src FROM knn",
    "base_layer": "SELECT src, dst, sqrt(d) AS w FROM knn WHERE sqrt(d) >= 1e-4",
    "parts2": f"SELECT cid, CAST((cid + 1 + cid // 13) % {BLOCKS} AS INTEGER) AS pid FROM c",
    "contingency": "SELECT n.pid AS new_pid, o.pid AS old_pid, count(*) AS n FROM parts2 n JOIN c o USING (cid) GROUP BY ALL",
    "perms": "SELECT w.range AS w, x.range AS x, y.range AS y, z.range AS z FROM range(4) w, range(4) x, range(4) y, range(4) z WHERE len(list_distinct([w.range, x.range, y.range, z.range])) = 4",
    "kept": "SELECT w, x, y, z, sum(n) FILTER ([w, x, y, z][new_pid + 1] = old_pid) AS kept FROM perms, contingency GROUP BY ALL",
    "steps": "SELECT * FROM (VALUES " + ", ".join(f"({s}, '{o}', {'NULL' if b is None else b}, {'NULL' if e is None else e})" for s, o, b, e in RUNBOOK) + ') t(step, operation, "start", "end")',
    "shards": f"SELECT CAST(range AS INTEGER) AS pid FROM range({BLOCKS})",
    "load": "SELECT pid, count(np.qid) AS n FROM shards LEFT JOIN np USING (pid) GROUP BY pid",
    "sweep": "SELECT * FROM (SELECT 'BranchingFactor' AS mode, CAST(b AS DOUBLE) AS param, qid, pid FROM once, (VALUES (1), (4), (16)) t(b) WHERE rn <= b UNION ALL SELECT 'NProbe', p, qid, pid FROM seen, (VALUES (1), (2), (3)) t(p) WHERE ord <= p UNION ALL SELECT 'RecallTarget', t, qid, pid FROM rt_cum, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) g(t) WHERE ord = 1 OR (before < t AND prob > 0))",
    "shared_n": f"SELECT g.qid, s.pid, count(a.vec_id) AS n FROM (SELECT DISTINCT qid FROM gt) g CROSS JOIN shards s LEFT JOIN gt ON gt.qid = g.qid LEFT JOIN a ON a.vec_id = gt.vec_id AND a.pid = s.pid GROUP BY g.qid, s.pid",
    "shares": "SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY n DESC, pid) AS INTEGER) AS r, CAST(sum(n) OVER (PARTITION BY qid ORDER BY n DESC, pid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM shared_n",
}


def _sql(body: str) -> str:
    """body with the fixtures that it needs before it."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b(?!\.)", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    if not head:
        return body
    own = body.removeprefix("WITH ").removeprefix("RECURSIVE ") if body.startswith("WITH ") else ""
    return ("WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH ") + head + (", " + own if own else " " + body)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the fixtures under its name, with its SQL."""

    def add(f: Callable[[Fixtures], DataFrame]):
        QUERIES[f.__name__] = partial(lambda f, spark, sf_dir: f(Fixtures(spark, sf_dir)), f)
        if sql:
            ORACLES[f.__name__] = _sql(sql)
        return f

    return add


def exploded(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(vector).alias("pos", "x")).select(*keep, "pos", r6("x").alias("value"))


_UNNEST = f"CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range({DIM})) p"


# sources


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id >= 100 AND vec_id < 200")
def scan_range(x: Fixtures) -> DataFrame:
    return x.raw.where("vec_id >= 100 and vec_id < 200").select("vec_id", "label", F.size("embedding").alias("dim"))


@query("SELECT vec_id FROM embeddings ORDER BY (vec_id * 2654435761) % 4294967296, vec_id LIMIT 100")
def sample_vectors(x: Fixtures) -> DataFrame:
    return clustering.sample_vectors(x.raw, 100).select("vec_id")


@query('SELECT step, operation, count(vec_id) AS vectors FROM steps LEFT JOIN embeddings ON vec_id >= "start" AND vec_id < "end" GROUP BY step, operation')
def runbook_steps(x: Fixtures) -> DataFrame:
    hit = (F.col("vec_id") >= F.col("start")) & (F.col("vec_id") < F.col("end"))
    return F.broadcast(x.steps).join(x.raw.select("vec_id"), hit, "left").groupBy("step", "operation").agg(F.count("vec_id").alias("vectors"))


@query("SELECT vec_id, cid, pid, deleted FROM idx")
def index_roundtrip(x: Fixtures) -> DataFrame:
    path = storage.scratch(x.spark, "index")
    Index.from_tables(x.router, x.counted(), x.index(), path, DIM, BLOCKS)
    return Index.load(x.spark, path).vectors.select("vec_id", "cid", "pid", "deleted")


@query("SELECT CAST(4 AS INTEGER) AS step, CAST(5 AS INTEGER) AS next_step")
def checkpoint_resume(x: Fixtures) -> DataFrame:
    """Checkpoints of steps 2, 4 and 6 on disk, the last one without its marker."""
    path = storage.scratch(x.spark, "replay")
    index = Index.from_tables(x.router, x.counted(), x.index(), os.path.join(path, "index"), DIM, BLOCKS)
    run = replay.Replay(x.spark, x.vectors, x.queries, path, CENTERS, BLOCKS, CENTERS)
    for step in (2, 4, 6):
        run.index.meta["step"] = step
        run.index._commit()
        at = run.checkpoint()
    os.remove(os.path.join(at, "COMMITTED"))
    shutil.copytree(at, os.path.join(path, "checkpoints", "s000004"))
    with open(os.path.join(path, "checkpoints", "s000004", "CURRENT"), "w") as f:
        json.dump(index.meta | {"step": 4}, f)
    open(os.path.join(path, "checkpoints", "s000004", "COMMITTED"), "w").close()
    shutil.rmtree(os.path.join(path, "index"))
    again = replay.Replay(x.spark, x.vectors, x.queries, path, CENTERS, BLOCKS, CENTERS)
    return x.spark.createDataFrame([(again.step, again.step + 1)], "step int, next_step int").where(F.lit(again.index.vectors.count() > 0))


def _file(x: Fixtures, name: str) -> str:
    folder = storage.scratch(x.spark, "files")
    os.makedirs(folder)
    return os.path.join(folder, name)


@query(f"SELECT vec_id, pos, CAST(embedding[pos + 1] AS DOUBLE) AS value FROM embeddings {_UNNEST} WHERE vec_id >= 50 AND vec_id < 150")
def vector_file_scan(x: Fixtures) -> DataFrame:
    """Vectors written as an fbin file, a range of its rows read."""
    vecs.register(x.spark)
    path = _file(x, "base.fbin")
    vecs.write_vectors(x.raw.where("vec_id < 200"), path)
    rows = x.spark.read.format("vecs").option("start", 50).option("rows", 100).load(path)
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("double").alias("value"))


@query("SELECT qid, rank, vec_id FROM gt")
def ground_truth_file(x: Fixtures) -> DataFrame:
    vecs.register(x.spark)
    path = _file(x, "gt.ivecs")
    vecs.write_ground_truth(x.truth(), path, "ivecs")
    return x.spark.read.format("groundtruth").option("kind", "ivecs").load(path)


@query('SELECT CAST(step AS INTEGER) AS step, operation, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM steps')
def runbook_file(x: Fixtures) -> DataFrame:
    path = _file(x, "runbook.yaml")
    runbook.save(x.steps, path, "fixture")
    return runbook.load(x.spark, path, "fixture")


@query("SELECT vec_id, c.cid, pid, cnt FROM a JOIN c USING (cid, pid) JOIN counted USING (cid)")
def step_state_files(x: Fixtures) -> DataFrame:
    """A step's centroids, counts, labels and partition, written as files and read again."""
    folder = os.path.dirname(_file(x, "x"))
    states.write_centers(x.counted(), folder, 3)
    states.write_labels(x.placed(), folder, 3)
    states.write_partitions(x.parts(), folder, 3)
    got = states.read_state(x.spark, folder, states.first_step(folder, folder))
    return got["labels"].join(got["router"], "cid").join(got["centers"].select("cid", "cnt"), "cid").select("vec_id", "cid", "pid", "cnt")


@query("SELECT vec_id, cid, pid, (deleted AND vec_id < 280) OR vec_id BETWEEN 130 AND 159 AS deleted FROM idx WHERE vec_id < 280 UNION ALL SELECT vec_id, cid, pid, false FROM a WHERE vec_id BETWEEN 280 AND 399")
def index_insert_delete(x: Fixtures) -> DataFrame:
    """The index on disk after an insert that replaces 20 ids and a delete, told from its parts."""
    index = Index.from_tables(x.router, x.counted(), x.index().where("vec_id < 300"), storage.scratch(x.spark, "index"), DIM, BLOCKS)
    index.insert(x.vectors.where("vec_id between 280 and 399"))
    index.delete(130, 160)
    return Index.load(x.spark, index.path, verify=True).vectors.select("vec_id", "cid", "pid", "deleted")


@query("SELECT vec_id, idx.cid, parts2.pid, deleted FROM idx JOIN parts2 USING (cid) WHERE NOT deleted UNION ALL SELECT vec_id, cid, pid, deleted FROM idx WHERE deleted")
def index_delta_rebuild(x: Fixtures) -> DataFrame:
    """The index on disk after centroids changed shards; only the vectors that move are written."""
    index = Index.from_tables(x.router, x.counted(), x.index(), storage.scratch(x.spark, "index"), DIM, BLOCKS)
    index.rebuild(maintenance.Repartition(x.other_parts(), 0, CENTERS), full=False)
    return index.vectors.select("vec_id", "cid", "pid", "deleted")


@query("SELECT p AS pid, count(*) FILTER (o = p) AS departed, count(*) FILTER (n = p) AS arrived FROM (SELECT idx.pid AS o, parts2.pid AS n FROM idx JOIN parts2 USING (cid) WHERE NOT deleted AND idx.pid <> parts2.pid) m, (SELECT pid AS p FROM shards) s GROUP BY p")
def rebuild_report(x: Fixtures) -> DataFrame:
    index = Index.from_tables(x.router, x.counted(), x.index(), storage.scratch(x.spark, "index"), DIM, BLOCKS)
    index.rebuild(maintenance.Repartition(x.other_parts(), 0, CENTERS), full=False)
    return x.spark.createDataFrame(index.report, "pid int, departed bigint, arrived bigint, tombstones bigint").drop("tombstones")


# functions


def _pairs(x: Fixtures) -> DataFrame:
    one = x.raw.select(F.col("vec_id").alias("a"), distance.doubles("embedding").alias("va"))
    two = x.raw.select(F.col("vec_id").alias("b"), distance.doubles("embedding").alias("vb"))
    return one.where("a < 50").crossJoin(F.broadcast(two.where("b < 20")))


_PAIRS = "FROM raw x, raw y WHERE x.vec_id < 50 AND y.vec_id < 20"


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round({_d2('x.e', 'y.e')}, 6) AS d {_PAIRS}")
def l2_distance(x: Fixtures) -> DataFrame:
    return _pairs(x).select("a", "b", r6(distance.l2sq(F.col("va"), F.col("vb"), DIM)).alias("d"))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round(1 - {_dot('x.e', 'y.e')}, 6) + 0.0 AS d {_PAIRS}")
def ip_distance(x: Fixtures) -> DataFrame:
    return _pairs(x).select("a", "b", r6(distance.ip_distance(F.col("va"), F.col("vb"), DIM)).alias("d"))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round(1 - {_dot('x.e', 'y.e')} / (sqrt({_dot('x.e', 'x.e')}) * sqrt({_dot('y.e', 'y.e')})), 6) + 0.0 AS d {_PAIRS}")
def cosine_distance(x: Fixtures) -> DataFrame:
    return _pairs(x).select("a", "b", r6(distance.cosine_distance(F.col("va"), F.col("vb"), DIM)).alias("d"))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round(sqrt({_d2('x.e', 'y.e')}), 6) AS d {_PAIRS}")
def euclidean_distance(x: Fixtures) -> DataFrame:
    return _pairs(x).select("a", "b", r6(distance.euclidean(F.col("va"), F.col("vb"), DIM)).alias("d"))


@query(f"SELECT vec_id, pos, round(e[pos + 1] / (sqrt({_dot('e', 'e')}) + 1e-30), 6) AS value FROM v {_UNNEST} WHERE vec_id < 100")
def normalize_vectors(x: Fixtures) -> DataFrame:
    rows = x.vectors.where("vec_id < 100")
    return exploded(rows.select("vec_id", distance.normalized(F.col("embedding"), DIM).alias("u")), "u", "vec_id")


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, list_bool_and(list_transform(list_zip(x.e, y.e), lambda z: abs(z[1] - z[2]) <= 1e-5)) AS same {_PAIRS}")
def vectors_equal(x: Fixtures) -> DataFrame:
    return _pairs(x).select("a", "b", distance.equal_within(F.col("va"), F.col("vb")).alias("same"))


# the index as a collection


@query("SELECT vec_id, label FROM embeddings WHERE NOT vec_id BETWEEN 100 AND 109 UNION ALL SELECT vec_id - 50, label + 100 FROM embeddings WHERE vec_id BETWEEN 150 AND 159 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id < 5")
def upsert_vectors(x: Fixtures) -> DataFrame:
    all_ = x.raw.select("vec_id", "label", "embedding")
    changed = all_.where("vec_id between 150 and 159").selectExpr("vec_id - 50 as vec_id", "label + 100 as label", "embedding")
    added = all_.where("vec_id < 5").selectExpr("vec_id + 1000000 as vec_id", "label", "embedding")
    return updates.upsert(all_, changed.union(added)).select("vec_id", "label")


@query("SELECT vec_id, deleted AND NOT vec_id BETWEEN 60 AND 79 AS deleted FROM idx")
def unmark_deleted(x: Fixtures) -> DataFrame:
    return updates.unmark_deleted(x.index(), 60, 80).select("vec_id", "deleted")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 17 = 3")
def get_items(x: Fixtures) -> DataFrame:
    ids = x.raw.select("vec_id").where("vec_id % 17 = 3")
    return updates.get_items(x.raw, ids).select("vec_id", "label")


@query("SELECT count(*) AS current, count(*) FILTER (NOT deleted) AS live FROM idx")
def index_counts(x: Fixtures) -> DataFrame:
    return updates.index_counts(x.index())


# exact search


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("d", r6("d"))


def _ranked_sql(source: str, key: str = "vec_id", k: int = K) -> str:
    return f"SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, {key}) AS INTEGER) AS rank, {key}, round(d, 6) AS d FROM {source} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY x.d, {key}) <= {k}"


@query("SELECT qid, rank, vec_id, round(d, 6) AS d FROM gt")
def exact_knn(x: Fixtures) -> DataFrame:
    return _rounded(x.truth())


@query(_ranked_sql("(SELECT * FROM pairs WHERE label = 3) x"))
def filtered_knn(x: Fixtures) -> DataFrame:
    return _rounded(nearest.exact_knn(x.vectors, x.queries, K, F.col("label") == 3))


@query("SELECT qid, vec_id, round(d, 6) AS d FROM pairs WHERE d <= 1.6")
def epsilon_search(x: Fixtures) -> DataFrame:
    return _rounded(nearest.epsilon_search(x.vectors, x.queries, 1.6))


@query(_ranked_sql("(SELECT qid, vec_id // 5 AS doc, min(d) AS d FROM pairs GROUP BY ALL) x", "doc"))
def multivector_search(x: Fixtures) -> DataFrame:
    docs = x.vectors.select("vec_id", F.floor(F.col("vec_id") / 5).alias("doc"))
    return _rounded(nearest.multivector_search(x.vectors, x.queries, docs, K))


@query("SELECT qid, pid, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, round(p.d, 6) AS d FROM (SELECT qid, vec_id, d FROM pairs) p JOIN (SELECT vec_id, pid FROM a) t USING (vec_id) JOIN np USING (qid, pid) WINDOW w AS (PARTITION BY qid, pid ORDER BY p.d, vec_id) QUALIFY row_number() OVER w <= 5")
def local_topk(x: Fixtures) -> DataFrame:
    return _rounded(routing.local_topk(x.vectors, x.queries, x.nprobe(), 5, exclude_self=True, router=x.router))


def _damaged(x: Fixtures) -> DataFrame:
    """Vectors of which some are null, empty, short, or hold a null, NaN or infinity."""
    v, k = F.col("embedding"), F.col("vec_id") % 11
    first = lambda value: F.concat(F.array(F.lit(value).cast("double")), F.slice(v, 2, DIM))
    bad = F.when(k == 1, F.lit(None)).when(k == 2, F.slice(v, 1, 0)).when(k == 3, F.slice(v, 1, 10)).when(k == 4, first(None)).when(k == 5, first(float("nan"))).when(k == 6, first(float("-inf")))
    return x.vectors.withColumn("embedding", bad.when(k == 7, F.concat(v, F.array(F.lit(0.0)))).otherwise(v))


@query("SELECT vec_id, cid, pid FROM a WHERE vec_id % 11 NOT BETWEEN 1 AND 7")
def null_vectors(x: Fixtures) -> DataFrame:
    return routing.place(_damaged(x), x.router)


@query(_ranked_sql("(SELECT * FROM pairs WHERE vec_id % 11 NOT BETWEEN 1 AND 7 AND qid % 11 NOT BETWEEN 1 AND 7) x"))
def null_vectors_knn(x: Fixtures) -> DataFrame:
    damaged = _damaged(x)
    return _rounded(nearest.exact_knn(damaged, damaged.where("vec_id < 50").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), K))


# clustering


@query("SELECT vec_id, cid, round(d, 6) AS d FROM a")
def assign_nearest_center(x: Fixtures) -> DataFrame:
    return _rounded(nearest.assign(x.vectors, x.router))


def _lloyd_sql(rounds: int) -> str:
    steps, last = [], "c0"
    head = "c0 AS (SELECT cid, ce FROM c)"
    for i in range(1, rounds + 1):
        steps.append(f"n{i} AS (SELECT vec_id, e, cid FROM (SELECT vec_id, e, cid, {_d2('e', 'ce')} AS d FROM v, {last}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1)")
        steps.append(f"m{i} AS (SELECT cid, list(m ORDER BY pos) AS m FROM (SELECT cid, pos, sum(e[pos + 1]) / count(*) AS m FROM n{i} {_UNNEST} GROUP BY cid, pos) GROUP BY cid)")
        steps.append(f"k{i} AS (SELECT o.cid, coalesce(m, ce) AS ce FROM {last} o LEFT JOIN m{i} USING (cid))")
        last = f"k{i}"
    return "WITH " + ", ".join([head, *steps]) + f" SELECT cid, pos, round(ce[pos + 1], 6) AS value FROM {last} {_UNNEST}"


@query(_lloyd_sql(3))
def kmeans_lloyd(x: Fixtures) -> DataFrame:
    start = nearest.Table(x.router, "cid", "cv", nearest.MAX_CENTERS).vectors
    centers, _, _ = clustering.lloyd(x.vectors, start, 3, tolerance=-1)
    return exploded(clustering.centers_frame(x.spark, centers), "cv", "cid")


@query("SELECT round(sum(d), 6) AS inertia FROM a")
def kmeans_inertia(x: Fixtures) -> DataFrame:
    return clustering.inertia(x.vectors, x.router).select(r6("inertia").alias("inertia"))


@query(f"SELECT c.cid, pos, round(coalesce(sum(a.e[pos + 1]), 0) / greatest(count(a.vec_id), 1), 6) AS value, count(a.vec_id) AS cnt FROM c {_UNNEST} LEFT JOIN a ON a.cid = c.cid AND a.vec_id >= 40 GROUP BY c.cid, pos")
def centers_from_sums(x: Fixtures) -> DataFrame:
    some = x.vectors.where("vec_id >= 40")
    return exploded(clustering.centers_from_sums(nearest.assign(some, x.router, ("embedding",)), x.router, DIM), "cv", "cid", "cnt")


@query("SELECT CAST(sum(cnt) AS BIGINT) AS total, count(*) FILTER (cnt = 0) AS zero, count(*) FILTER (cnt > 0) AS nonzero, min(cnt) AS min_count, max(cnt) AS max_count, round(avg(cnt) FILTER (cnt > 0), 6) AS mean_nonzero FROM counted")
def center_count_stats(x: Fixtures) -> DataFrame:
    return clustering.center_count_stats(x.counted()).withColumn("mean_nonzero", r6("mean_nonzero"))


# graph


@query("SELECT src, dst, round(d, 6) AS d FROM knn")
def centroid_knn_graph(x: Fixtures) -> DataFrame:
    return _rounded(x.graph())


@query("SELECT src, dst FROM sym")
def symmetrize_graph(x: Fixtures) -> DataFrame:
    return graph.symmetrize(x.graph())


@query("SELECT src, dst, round(w, 6) AS w FROM base_layer JOIN (SELECT cid FROM counted WHERE cnt > 0) s ON s.cid = src JOIN (SELECT cid FROM counted WHERE cnt > 0) t ON t.cid = dst")
def base_layer_edges(x: Fixtures) -> DataFrame:
    return graph.base_layer_edges(x.counted(), x.graph(), "drop_edges").withColumn("w", r6("w"))


@query("SELECT src, dst, greatest(1, CAST(round((1 / w) / (SELECT max(1 / w) FROM base_layer) * 10000) AS BIGINT)) AS weight FROM base_layer")
def edge_weights(x: Fixtures) -> DataFrame:
    return graph.edge_weights(graph.base_layer_edges(x.router, x.graph()))


@query("SELECT count(*) AS edges, count(*) FILTER (s.pid <> t.pid) AS cut, round(count(*) FILTER (s.pid <> t.pid) / count(*), 6) AS ratio FROM sym JOIN c s ON s.cid = src JOIN c t ON t.cid = dst WHERE src < dst")
def edge_cut_ratio(x: Fixtures) -> DataFrame:
    return graph.edge_cut(graph.symmetrize(x.graph()), x.parts()).withColumn("ratio", r6("ratio"))


@query("SELECT pid, count(*) AS size, round(count(*) / avg(count(*)) OVER (), 6) AS ratio FROM parts2 GROUP BY pid")
def partition_balance(x: Fixtures) -> DataFrame:
    return graph.balance(x.other_parts()).withColumn("ratio", r6("ratio"))


@query("SELECT new_pid, old_pid, n FROM contingency")
def partition_contingency(x: Fixtures) -> DataFrame:
    return graph.contingency(x.other_parts(), x.parts())


@query("SELECT CAST((SELECT count(*) FROM c) - max(kept) AS BIGINT) AS moved FROM kept")
def moved_centers(x: Fixtures) -> DataFrame:
    return graph.moved_centers(x.other_parts(), x.parts(), BLOCKS).agg(F.count("*").alias("moved"))


@query("SELECT CAST((SELECT count(*) FROM c) - max(kept) AS BIGINT) AS moved, (SELECT count(*) FROM c) AS total, round(((SELECT count(*) FROM c) - max(kept)) / (SELECT count(*) FROM c), 6) AS phi FROM kept")
def drift_phi(x: Fixtures) -> DataFrame:
    return graph.drift(x.other_parts(), x.parts(), BLOCKS).withColumn("phi", r6("phi"))


@query("SELECT (SELECT count(*) FROM c) AS centers, CAST(4 AS BIGINT) AS shards, true AS balanced, count(*) FILTER (s.pid <> t.pid) AS cut_by_modulo, true AS cuts_less FROM sym JOIN c s ON s.cid = src JOIN c t ON t.cid = dst WHERE src < dst")
def balanced_partition(x: Fixtures) -> DataFrame:
    """What any good partition of the graph has: all centroids placed, shards within 3 %, fewer edges cut than by cid modulo the shards."""
    parts = graph.partition(x.router, BLOCKS, DEGREE).persist()
    edges = graph.symmetrize(x.graph()).persist()
    most = math.ceil((1 + partitioner.IMBALANCE) * CENTERS / BLOCKS)
    placed = graph.balance(parts).agg(F.sum("size").alias("centers"), F.count("*").alias("shards"), (F.max("size") <= most).alias("balanced"))
    cut, plain = graph.edge_cut(edges, parts).select(F.col("cut").alias("own")), graph.edge_cut(edges, x.parts()).select(F.col("cut").alias("cut_by_modulo"))
    return placed.crossJoin(plain).crossJoin(cut).select("centers", "shards", "balanced", "cut_by_modulo", (F.col("own") < F.col("cut_by_modulo")).alias("cuts_less"))


@query("SELECT (SELECT count(*) FROM c) AS centers, CAST(0 AS BIGINT) AS members, round(sum(d), 6) AS first_inertia, true AS fits_better FROM a")
def kmeans_build(x: Fixtures) -> DataFrame:
    """What any good clustering has: as many centroids, no members yet, and less inertia than the first ids as centroids."""
    got = clustering.kmeans(x.vectors, CENTERS, restarts=2, iterations=20).persist()
    counted = got.agg(F.count("*").alias("centers"), F.sum("cnt").alias("members"))
    both = clustering.inertia(x.vectors, x.router).select(r6("inertia").alias("first_inertia")).crossJoin(clustering.inertia(x.vectors, got))
    return counted.crossJoin(both).select("centers", "members", "first_inertia", (F.col("inertia") < F.col("first_inertia")).alias("fits_better"))


# routing


@query("SELECT qid, CAST(rn AS INTEGER) AS rn, cid, round(d, 6) AS d FROM qc WHERE rn <= 5")
def closest_centers(x: Fixtures) -> DataFrame:
    return _rounded(nearest.closest_centers(x.queries, x.router, 5))


@query("SELECT qid, pid, ord FROM bf")
def route_branching_factor(x: Fixtures) -> DataFrame:
    return routing.branching_factor(x.queries, x.router, 4)


@query("SELECT qid, pid, ord FROM np")
def route_nprobe(x: Fixtures) -> DataFrame:
    return x.nprobe()


@query("SELECT qid, pid, ord, round(prob, 6) AS prob FROM rt")
def route_recall_target(x: Fixtures) -> DataFrame:
    return routing.recall_target(x.queries, x.router, 0.9).withColumn("prob", r6("prob"))


@query(
    f"WITH near AS (SELECT qid, pid, d, row_number() OVER (PARTITION BY qid, pid ORDER BY rn) AS r FROM qc WHERE rn <= 50), "
    f"density AS (SELECT qid, pid, ln(CAST(max(r) AS DOUBLE)) - {DIM} * ln(greatest(sqrt(max(d)), 1e-10)) AS g FROM near WHERE r <= 3 GROUP BY qid, pid), "
    "e AS (SELECT qid, pid, exp(g - max(g) OVER (PARTITION BY qid)) AS e FROM density), "
    "p AS (SELECT qid, pid, e / sum(e) OVER (PARTITION BY qid) AS prob FROM e), "
    "s AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY prob DESC, pid) AS INTEGER) AS ord, coalesce(sum(prob) OVER (PARTITION BY qid ORDER BY prob DESC, pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) "
    "SELECT qid, pid, ord, round(prob, 6) AS prob FROM s WHERE ord = 1 OR (before < 0.9 AND prob > 0)"
)
def route_recall_target_extended(x: Fixtures) -> DataFrame:
    return routing.recall_target_extended(x.queries, x.router, 0.9, DIM).withColumn("prob", r6("prob"))


@query("SELECT mode, param, qid, pid FROM sweep")
def routing_sweep(x: Fixtures) -> DataFrame:
    return routing.sweep(x.queries, x.router, [1, 4, 16], [1, 2, 3], [0.5, 0.9, 1.0])


@query("SELECT vec_id, cid, pid FROM a WHERE vec_id BETWEEN 300 AND 399")
def route_insert(x: Fixtures) -> DataFrame:
    return routing.place(x.vectors.where("vec_id between 300 and 399"), x.router)


@query("SELECT vec_id, pid FROM a WHERE vec_id BETWEEN 450 AND 549 AND vec_id < 500")
def route_delete(x: Fixtures) -> DataFrame:
    ids = x.spark.range(450, 550).select(F.col("id").alias("vec_id"))
    return routing.placement_of(ids, x.placed().where("vec_id < 500"))


# routed search


def _search_sql(routes: str) -> str:
    return f"SELECT qid, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, round(p.d, 6) AS d FROM (SELECT qid, vec_id, d FROM pairs) p JOIN (SELECT vec_id, pid FROM a) t USING (vec_id) JOIN {routes} USING (qid, pid) WINDOW w AS (PARTITION BY qid ORDER BY p.d, vec_id) QUALIFY row_number() OVER w <= {K}"


@query(_search_sql("bf"))
def search_branching_factor(x: Fixtures) -> DataFrame:
    return _rounded(routing.search(x.vectors, x.queries, routing.branching_factor(x.queries, x.router, 4), K, exclude_self=True, router=x.router))


@query(_search_sql("np"))
def search_nprobe(x: Fixtures) -> DataFrame:
    return _rounded(routing.search(x.vectors, x.queries, x.nprobe(), K, exclude_self=True, router=x.router))


@query(_search_sql("rt"))
def search_recall_target(x: Fixtures) -> DataFrame:
    return _rounded(routing.search(x.vectors, x.queries, routing.recall_target(x.queries, x.router, 0.9), K, exclude_self=True, router=x.router))


# updates


@query("SELECT pid, count(*) AS n FROM a GROUP BY pid")
def partition_counts(x: Fixtures) -> DataFrame:
    return updates.partition_counts(x.placed())


@query("SELECT vec_id, cid, pid, deleted FROM idx WHERE vec_id < 280 UNION ALL SELECT vec_id, cid, pid, false FROM a WHERE vec_id BETWEEN 280 AND 399")
def insert_step(x: Fixtures) -> DataFrame:
    index = x.index().where("vec_id < 300")
    return updates.insert_step(index, x.vectors.where("vec_id between 280 and 399"), x.router).select("vec_id", "cid", "pid", "deleted")


@query("SELECT vec_id, pid, deleted OR vec_id BETWEEN 100 AND 199 AS deleted FROM idx")
def delete_step(x: Fixtures) -> DataFrame:
    return updates.delete_step(x.index(), 100, 200).select("vec_id", "pid", "deleted")


_BATCH = "b AS (SELECT cid, pos, count(*) AS k, sum(e[pos + 1]) AS s FROM a " + _UNNEST + " WHERE vec_id BETWEEN {} AND {} GROUP BY cid, pos), t AS (SELECT counted.cid, p.pos, ce[p.pos + 1] AS x, cnt, coalesce(k, 0) AS k, s FROM counted " + _UNNEST + " LEFT JOIN b ON b.cid = counted.cid AND b.pos = p.pos)"


@query("WITH " + _BATCH.format(300, 399) + " SELECT cid, pos, round(CASE WHEN k > 0 THEN (x * cnt + s) / (cnt + k) ELSE x END, 6) AS value, cnt + k AS cnt FROM t")
def centers_after_insert(x: Fixtures) -> DataFrame:
    return exploded(updates.centers_after_insert(x.counted(), x.placed().where("vec_id between 300 and 399"), DIM), "cv", "cid", "cnt")


@query("WITH " + _BATCH.format(50, 119) + " SELECT cid, pos, round(CASE WHEN k > 0 AND cnt > k THEN (x * cnt - s) / (cnt - k) ELSE x END, 6) AS value, greatest(cnt - k, 0) AS cnt FROM t")
def centers_after_delete(x: Fixtures) -> DataFrame:
    return exploded(updates.centers_after_delete(x.counted(), x.placed().where("vec_id between 50 and 119"), DIM), "cv", "cid", "cnt")


@query("SELECT pid, count(*) FILTER (NOT deleted) AS live FROM idx GROUP BY pid")
def shard_sizes(x: Fixtures) -> DataFrame:
    return updates.shard_sizes(x.index())


@query("SELECT pid, round(count(*) FILTER (deleted) / count(*), 6) AS ratio FROM idx GROUP BY pid")
def tombstone_ratio(x: Fixtures) -> DataFrame:
    return updates.tombstone_ratio(x.index()).withColumn("ratio", r6("ratio"))


# maintenance


@query("SELECT count(*) AS centers_moved, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS elements_moved FROM counted JOIN parts2 USING (cid) JOIN c USING (cid) WHERE parts2.pid <> c.pid")
def elements_moved(x: Fixtures) -> DataFrame:
    moved = x.other_parts().join(x.parts().toDF("cid", "old_pid"), "cid").where("pid <> old_pid")
    return maintenance.elements_moved(moved, x.counted())


@query("SELECT step, CASE WHEN step % 6 <> 0 OR operation NOT IN ('insert', 'delete') THEN 'none' WHEN tomb >= 0.5 THEN 'full' WHEN moved >= 10 THEN 'delta' ELSE 'none' END AS decision FROM (SELECT CAST(vec_id AS INTEGER) AS step, ['insert', 'delete', 'search'][vec_id % 3 + 1] AS operation, vec_id % 25 AS moved, (vec_id % 7) / 10 AS tomb FROM embeddings WHERE vec_id BETWEEN 1 AND 120) s")
def rebuild_decision(x: Fixtures) -> DataFrame:
    step = F.col("vec_id")
    rows = x.raw.where("vec_id between 1 and 120").select(step.cast("int").alias("step"), F.element_at(F.array(F.lit("insert"), F.lit("delete"), F.lit("search")), (step % 3 + 1).cast("int")).alias("operation"), (step % 25).alias("moved"), (step % 7 / 10).alias("tombstones"))
    return maintenance.decisions(rows, 10, CENTERS)


@query("SELECT vec_id, idx.cid, a2.pid FROM idx JOIN a2 USING (vec_id) WHERE NOT deleted")
def rebuild_full(x: Fixtures) -> DataFrame:
    return maintenance.rebuild_full(x.index(), x.centroids(100)).select("vec_id", "cid", "pid")


@query("SELECT vec_id, idx.pid AS from_pid, a2.pid AS to_pid FROM idx JOIN a2 USING (vec_id) WHERE NOT deleted AND idx.pid <> a2.pid")
def rebuild_delta_movers(x: Fixtures) -> DataFrame:
    return maintenance.delta_movers(x.index(), x.centroids(100))


# runbooks


@query("SELECT vec_id FROM embeddings JOIN steps ON vec_id >= \"start\" AND vec_id < \"end\" WHERE step <= 6 AND operation IN ('insert', 'delete') GROUP BY vec_id HAVING arg_max(operation, step) = 'insert'")
def active_set(x: Fixtures) -> DataFrame:
    return updates.active_set(x.steps, x.vectors, 6)


@query("SELECT range AS qid, range % 50 AS source, range < 50 AS original FROM range(120)")
def scaled_queries(x: Fixtures) -> DataFrame:
    return updates.scaled_queries(x.queries, 2.4)


@query("SELECT CAST(sum(\"end\" - \"start\") FILTER (operation IN ('insert', 'delete')) AS BIGINT) AS updates, count(*) FILTER (operation = 'search') AS searches, round(0.2 / (1 - 0.2) * sum(\"end\" - \"start\") FILTER (operation IN ('insert', 'delete')) / (count(*) FILTER (operation = 'search') * 50), 6) AS scale FROM steps")
def search_fraction_scale(x: Fixtures) -> DataFrame:
    return updates.search_scale(x.steps, 0.2, 50).withColumn("scale", r6("scale"))


def _step_parts(step: int) -> Column:
    return ((F.col("cid") + step * F.floor(F.col("cid") / 7)) % BLOCKS).cast("int")


@query(
    f"WITH RECURSIVE sp AS (SELECT s.range AS step, cid, (cid + s.range * (cid // 7)) % {BLOCKS} AS pid FROM c, range(1, 7) s), "
    "cross_n AS (SELECT n.step AS s, o.step AS t, n.pid AS new_pid, o.pid AS old_pid, count(*) AS n FROM sp n JOIN sp o USING (cid) WHERE n.step > o.step GROUP BY ALL), "
    "best AS (SELECT s, t, max(k) AS kept FROM (SELECT s, t, w, x, y, z, coalesce(sum(n) FILTER ([w, x, y, z][new_pid + 1] = old_pid), 0) AS k FROM cross_n, perms GROUP BY ALL) GROUP BY s, t), "
    f"phi AS (SELECT s, t, ({CENTERS} - kept) / {CENTERS} AS phi FROM best), "
    "walk AS (SELECT 1::BIGINT AS step, 0::DOUBLE AS phi, false AS rebuilt, 1::BIGINT AS active UNION ALL SELECT p.s, CAST(p.phi AS DOUBLE), p.phi > 0.3, CASE WHEN p.phi > 0.3 THEN p.s ELSE walk.active END FROM walk JOIN phi p ON p.s = walk.step + 1 AND p.t = walk.active) "
    "SELECT CAST(step AS INTEGER) AS step, round(phi, 6) AS phi, rebuilt, CAST(active AS INTEGER) AS active FROM walk"
)
def threshold_simulation(x: Fixtures) -> DataFrame:
    rows = x.router.select("cid", *[_step_parts(s).alias(f"s{s}") for s in range(1, 7)]).collect()  # centroids
    steps = [(s, {r.cid: r[f"s{s}"] for r in rows}) for s in range(1, 7)]
    return x.spark.createDataFrame(maintenance.threshold_simulation(steps, BLOCKS, 0.3), "step int, phi double, rebuilt boolean, active int").withColumn("phi", r6("phi"))


# metrics


@query(f"SELECT count(found.vec_id) AS hits, count(DISTINCT gt.qid) AS queries, round(count(found.vec_id) / (count(DISTINCT gt.qid) * {K}), 6) AS recall FROM gt LEFT JOIN found ON found.qid = gt.qid AND found.vec_id = gt.vec_id")
def recall_at_k(x: Fixtures) -> DataFrame:
    found = routing.search(x.vectors, x.queries, x.nprobe(), K, exclude_self=True, router=x.router)
    return metrics.recall_at_k(found, x.truth(), K).withColumn("recall", r6("recall"))


_THEORY = f"SELECT count(DISTINCT gt.qid) AS queries, round(count(np.pid) / (count(DISTINCT gt.qid) * {K}), 6) AS recall FROM gt LEFT JOIN {{0}} ON {{0}}.vec_id = gt.vec_id LEFT JOIN np ON np.qid = gt.qid AND np.pid = {{0}}.pid"


@query(f"SELECT count(DISTINCT gt.qid) AS queries, round(count(np.pid) / (count(DISTINCT gt.qid) * {K}), 6) AS recall FROM gt LEFT JOIN (SELECT * FROM idx WHERE NOT deleted) i ON i.vec_id = gt.vec_id LEFT JOIN np ON np.qid = gt.qid AND np.pid = i.pid")
def theoretical_recall(x: Fixtures) -> DataFrame:
    return metrics.theoretical_recall(x.truth(), x.index().where("not deleted"), x.nprobe(), K).withColumn("recall", r6("recall"))


@query(_THEORY.format("a2"))
def theoretical_recall_rerouted(x: Fixtures) -> DataFrame:
    return metrics.rerouted_recall(x.truth(), x.vectors, x.centroids(100), x.nprobe(), K).withColumn("recall", r6("recall"))


@query("SELECT round(count(*) / 50, 6) AS avg_parts FROM bf")
def avg_parts_searched(x: Fixtures) -> DataFrame:
    return metrics.avg_parts_searched(routing.branching_factor(x.queries, x.router, 4), 50).select(r6("avg_parts").alias("avg_parts"))


@query(f"SELECT round(avg(n) / {BLOCKS}, 6) AS activation FROM (SELECT count(*) AS n FROM bf GROUP BY qid) t")
def activation(x: Fixtures) -> DataFrame:
    return metrics.activation(routing.branching_factor(x.queries, x.router, 4), BLOCKS).select(r6("activation").alias("activation"))


@query("SELECT round(stddev_pop(n) / avg(n), 6) AS cof FROM load")
def load_cof(x: Fixtures) -> DataFrame:
    return metrics.load_cof(x.nprobe(), BLOCKS).select(r6("cof").alias("cof"))


@query("SELECT round(max(n) / avg(n), 6) AS skew, first(pid ORDER BY n DESC, pid) AS hot_pid FROM load")
def load_skew(x: Fixtures) -> DataFrame:
    return metrics.load_skew(x.nprobe(), BLOCKS).withColumn("skew", r6("skew"))


@query("WITH n AS (SELECT mode, param, s.pid, count(w.qid) AS n FROM (SELECT DISTINCT mode, param FROM sweep) m CROSS JOIN shards s LEFT JOIN sweep w USING (mode, param, pid) GROUP BY mode, param, s.pid), r AS (SELECT *, n / avg(n) OVER (PARTITION BY mode, param) AS multiple, row_number() OVER (PARTITION BY mode, param ORDER BY n DESC, pid) AS r FROM n) SELECT mode, pid, round(sum(multiple), 6) AS load, count(*) FILTER (r = 1) AS times_hottest FROM r GROUP BY mode, pid")
def hot_shard_summary(x: Fixtures) -> DataFrame:
    return metrics.hot_shard_summary(routing.sweep(x.queries, x.router, [1, 4, 16], [1, 2, 3], [0.5, 0.9, 1.0]), BLOCKS).withColumn("load", r6("load"))


_SPREAD = "SELECT '{0}' AS measure, round(list_sort(list(x))[CAST(floor((count(*) - 1) * 0.05) AS BIGINT) + 1], 6) AS p5, round(list_sort(list(x))[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1], 6) AS p50, round(list_sort(list(x))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1], 6) AS p95, round(avg(x), 6) AS mean FROM (SELECT {1} AS x FROM s)"


@query("WITH s AS (SELECT qid, min(d) AS d0, max(d) AS d1 FROM (SELECT qid - 40 AS qid, d FROM qc WHERE qid >= 40) g GROUP BY qid) " + _SPREAD.format("relative", "(d1 - d0) / (d0 + 1e-10)") + " UNION ALL " + _SPREAD.format("absolute", "d1 - d0"))
def distance_spread(x: Fixtures) -> DataFrame:
    # those below 40 are centroids themselves
    return metrics.distance_spread(x.queries.where("qid >= 40"), x.router).select("measure", *[r6(c).alias(c) for c in ("p5", "p50", "p95", "mean")])


@query("SELECT pid, round(sum(prob) / 50, 6) AS prob, CAST(row_number() OVER (ORDER BY sum(prob) / 50 DESC, pid) AS INTEGER) AS rank FROM rt_prob GROUP BY pid")
def mean_partition_ranking(x: Fixtures) -> DataFrame:
    return metrics.mean_partition_ranking(routing.recall_target(x.queries, x.router, 1.0), 50).withColumn("prob", r6("prob"))


# bounds


@query(f"SELECT r AS nprobe, round(r / {BLOCKS}, 6) AS activation, round(avg(cum / {K}), 6) AS mean_recall, round(quantile_cont(cum / {K}, 0.05), 6) AS p5_recall, round(quantile_cont(cum / {K}, 0.95), 6) AS p95_recall FROM shares GROUP BY r")
def oracle_nprobe(x: Fixtures) -> DataFrame:
    return bounds.nprobe(x.shares(), K, BLOCKS).select("nprobe", *[r6(c).alias(c) for c in ("activation", "mean_recall", "p5_recall", "p95_recall")])


@query(
    f"WITH t AS (SELECT target, qid, coalesce(min(r) FILTER (cum >= ceil(target * {K} - 1e-9)), {BLOCKS}) AS shards, coalesce(min(cum) FILTER (cum >= ceil(target * {K} - 1e-9)), max(cum)) AS got FROM shares, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) g(target) GROUP BY target, qid) "
    f"SELECT target, round(avg(shards), 6) AS mean_shards, round(avg(got / {K}), 6) AS mean_recall, round(quantile_cont(shards, 0.95), 6) AS p95_shards FROM t GROUP BY target"
)
def oracle_recall_target(x: Fixtures) -> DataFrame:
    return bounds.recall_target(x.shares(), K, BLOCKS, [0.5, 0.9, 1.0]).select("target", *[r6(c).alias(c) for c in ("mean_shards", "mean_recall", "p95_shards")])


@query(
    f"WITH w AS (SELECT qid, count(*) AS m FROM bf GROUP BY qid), got AS (SELECT shares.qid, sum(n) / {K} AS actual FROM shares JOIN bf ON bf.qid = shares.qid AND bf.pid = shares.pid GROUP BY shares.qid), "
    f"g AS (SELECT m, actual, cum / {K} AS best, cum / {K} - actual AS gap FROM shares JOIN w ON w.qid = shares.qid AND r = m JOIN got ON got.qid = shares.qid) "
    "SELECT round(avg(m), 6) AS mean_shards, round(avg(actual), 6) AS actual, round(avg(best), 6) AS best, round(avg(gap), 6) AS gap, round(quantile_cont(gap, 0.05), 6) AS p5_gap, round(quantile_cont(gap, 0.95), 6) AS p95_gap FROM g"
)
def oracle_branching_factor(x: Fixtures) -> DataFrame:
    out = bounds.branching_factor(x.shares(), routing.branching_factor(x.queries, x.router, 4), K)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "WITH act AS (SELECT t.s, vec_id FROM embeddings JOIN steps ON vec_id >= \"start\" AND vec_id < \"end\", (VALUES (1), (4)) t(s) WHERE step <= t.s AND operation IN ('insert', 'delete') GROUP BY t.s, vec_id HAVING arg_max(operation, step) = 'insert'), "
    f"near AS (SELECT s, qid, vec_id FROM pairs JOIN act USING (vec_id) QUALIFY row_number() OVER (PARTITION BY s, qid ORDER BY d, vec_id) <= {K}), "
    "n AS (SELECT g.s, g.qid, h.pid, count(a.vec_id) AS n FROM (SELECT DISTINCT s, qid FROM near) g CROSS JOIN shards h LEFT JOIN near ON near.s = g.s AND near.qid = g.qid LEFT JOIN a ON a.vec_id = near.vec_id AND a.pid = h.pid GROUP BY g.s, g.qid, h.pid), "
    "r AS (SELECT s, qid, row_number() OVER w AS r, sum(n) OVER (PARTITION BY s, qid ORDER BY n DESC, pid ROWS UNBOUNDED PRECEDING) AS cum FROM n WINDOW w AS (PARTITION BY s, qid ORDER BY n DESC, pid)) "
    f"SELECT CAST(s AS INTEGER) AS step, 'NProbe' AS kind, CAST(r AS DOUBLE) AS param, round(r / {BLOCKS}, 6) AS activation, round(avg(cum / {K}), 6) AS recall FROM r GROUP BY s, r "
    f"UNION ALL SELECT CAST(s AS INTEGER), 'RecallTarget', 0.9::DOUBLE, round(avg(m) / {BLOCKS}, 6), round(avg(got / {K}), 6) FROM (SELECT s, qid, coalesce(min(r) FILTER (cum >= 9), {BLOCKS}) AS m, coalesce(min(cum) FILTER (cum >= 9), max(cum)) AS got FROM r GROUP BY s, qid) GROUP BY s"
)
def bounds_by_step(x: Fixtures) -> DataFrame:
    """The bounds after two steps of the runbook, under one routing state."""
    at = F.explode(F.array(F.lit(1), F.lit(4))).alias("step")
    states_, parts = x.router.select("cid", "cv", at), x.parts().select("cid", "pid", at)
    rows, _ = simulate.bounds_by_step(x.vectors, x.queries, x.steps, states_, parts, BLOCKS, K, [0.9])
    got = x.spark.createDataFrame([(r["step"], r["kind"], r["param"], r["activation"], r["recall"]) for r in rows], "step int, kind string, param double, activation double, recall double")
    return got.withColumn("activation", r6("activation")).withColumn("recall", r6("recall"))
