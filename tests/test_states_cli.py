"""Step states, damaged vectors in the index, and the command line."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera import simulate
from tessera.index import Index
from tessera.operators import graph
from tessera.plans.registry import BLOCKS, DIM, Fixtures, _damaged
from tessera.sources import runbook, states, vecs


@pytest.fixture(scope="module")
def x(spark):
    return Fixtures(spark, "/root/testdata/sf0.001")


def _table(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def test_states_round_trip(spark, x, tmp_path):
    folder = str(tmp_path)
    centers = x.router.select("cid", "cv").join(x.placed().groupBy("cid").agg(F.count("*").alias("cnt")), "cid").cache()
    states.write_centers(centers, folder, 7)
    states.write_labels(x.placed(), folder, 7)
    states.write_partitions(x.parts(), folder, 7, moved=5)
    edges = graph.base_layer_edges(x.router, x.graph())
    states.write_edges(edges, folder, 7)
    states.write_centers(x.counted(), folder, 3)
    assert states.steps(folder, "centers") == [3, 7] and states.first_step(folder, folder) == 7
    got = states.read_state(spark, folder, 7)
    assert sorted((r.cid, r.cv, r.cnt) for r in got["centers"].collect()) == sorted((r.cid, r.cv, r.cnt) for r in centers.collect())
    assert {r.cid: r.pid for r in got["router"].collect()} == {r.cid: r.pid for r in x.parts().collect()}
    assert {r.vec_id: r.cid for r in got["labels"].collect()} == {r.vec_id: r.cid for r in x.placed().collect()}
    assert states.read_partitions(spark, folder, 7)[1] == 5
    assert sorted(map(tuple, states.read_edges(spark, folder, 7).collect())) == sorted((r.src, r.dst, r.w) for r in edges.collect())
    index = Index.from_state(x.vectors, str(tmp_path / "i"), got)
    index.validate()
    assert index.blocks == BLOCKS and index.dim == DIM


def test_states_that_do_not_fit_are_errors(spark, x, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        states.first_step(folder, folder)
    states.write_centers(x.counted(), folder, 1)
    states.write_partitions(x.parts().where("cid < 9"), folder, 1)
    with pytest.raises(ValueError):
        states.read_state(spark, folder, 1)
    states.write_partitions(x.parts(), folder, 1)
    (tmp_path / "step_000001_labels.csv").write_text("0\n4000\n")
    with pytest.raises(ValueError):
        states.read_state(spark, folder, 1)
    (tmp_path / "step_000001_center_counts.csv").write_text("1\n")
    with pytest.raises(ValueError):
        states.read_centers(spark, folder, 1)
    (tmp_path / "step_000001_centers.csv").write_text("1,2\n3\n")
    with pytest.raises(ValueError):
        states.read_centers(spark, folder, 1)
    with pytest.raises(ValueError):
        states.path_of(folder, 1, "other")


def test_labels_of_several_blocks_keep_their_numbers(spark, tmp_path):
    (tmp_path / "step_000002_labels.csv").write_text("".join(f"{i % 7}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        labels = states.read_labels(spark, str(tmp_path), 2, start=100)
        assert labels.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, labels.collect())) == [(100 + i, i % 7) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_index_holds_usable_vectors_only(spark, x, tmp_path):
    good = "vec_id % 11 not between 1 and 7"
    index = Index.build(_damaged(x).where("vec_id < 200"), str(tmp_path / "i"), 8, 2, degree=4)
    index.validate()
    ids = lambda df: sorted(r.vec_id for r in df.select("vec_id").collect())
    assert ids(index.vectors) == ids(x.vectors.where("vec_id < 200").where(good))
    index.insert(_damaged(x).where("vec_id between 200 and 249"))
    index.validate()
    assert ids(index.vectors) == ids(x.vectors.where("vec_id < 250").where(good))
    queries = _damaged(x).where("vec_id < 30").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    found = index.search(queries, 3, "NProbe", 2).collect()
    assert {r.qid for r in found} == {q for q in range(30) if q % 11 not in range(1, 8)}
    assert sorted(found) == sorted(index.exact(queries, 3).collect())
    index.set_ef(50)
    assert index.ef == 50 and Index.load(spark, index.path).meta["ef_construction"] == 200 and sorted(index.search(queries, 3, "NProbe", 2).collect()) == sorted(found)
    with pytest.raises(ValueError):
        index.set_ef(0)
    with pytest.raises(ValueError):
        index.insert(spark.createDataFrame([(900, [1.0, 2.0])], "vec_id bigint, embedding array<double>"))


def test_many_changes_are_put_together(spark, x, tmp_path, monkeypatch):
    from tessera import index as module

    monkeypatch.setattr(module, "MAX_PARTS", 2)
    monkeypatch.setattr(module, "MAX_RANGES", 2)
    base = x.vectors.select("vec_id", "embedding")
    index = Index.from_tables(x.router, x.counted(), x.index().where("vec_id < 100"), str(tmp_path / "i"), DIM, BLOCKS)
    before = {r.vec_id for r in index.vectors.where("not deleted").collect()}
    for a in (90, 100, 120):
        index.insert(base.where(f"vec_id between {a} and {a + 19}"))
    assert len(index.meta["parts"]) <= 2 and not index.meta["replaced"]
    for a in (5, 30, 50, 95):
        index.delete(a, a + 5)
    assert len(index.meta["ranges"]) <= 2
    gone = {i for a in (5, 30, 50, 95) for i in range(a, a + 5)}
    index = Index.load(spark, index.path, verify=True)
    live = index.vectors.where("not deleted").collect()
    assert sorted(r.vec_id for r in live) == sorted((before | set(range(90, 140))) - gone)


@pytest.fixture(scope="module")
def files(spark, x, tmp_path_factory):
    vecs.register(spark)
    folder = tmp_path_factory.mktemp("cli")
    rows = x.vectors.where("vec_id < 200").select("vec_id", "embedding")
    vecs.write_vectors(rows, str(folder / "base.fbin"))
    vecs.write_vectors(rows.where("vec_id < 12"), str(folder / "queries.fbin"))
    steps = spark.createDataFrame([(1, "insert", 0, 150), (2, "search", None, None), (3, "delete", 20, 60)], runbook.SCHEMA)
    runbook.save(steps, str(folder / "book.yaml"), "small")
    return folder


def _run(spark, *args):
    cli.main([str(a) for a in args], spark)


def test_static_and_oracle(spark, files):
    some = ["--base", files / "base.fbin", "--queries", files / "queries.fbin", "--k", 5]
    _run(spark, "static", *some, "--out", files / "s", "--centers", 12, "--partitions", 3, "--m", 3, "--mode", "NProbe", "--params", 1, 3, "--runs", 1)
    one, all_ = (_table(files / "s" / "sweep" / f"NProbe_{p}.csv")[0] for p in (1, 3))
    assert float(all_["recall@k"]) == 1 and float(one["recall@k"]) <= 1 and float(one["avg_parts_searched"]) == 1 and float(one["qps"]) > 0
    assert sum(int(r["queries"]) for r in _table(files / "s" / "sweep" / "NProbe_1.diag.csv")) == 12
    assert json.loads((files / "s" / "build_metrics.json").read_text())["rows"] == 200
    _run(spark, "oracle", "--index", files / "s" / "index", *some[2:], "--out", files / "o")
    best = [float(r["mean_recall"]) for r in _table(files / "o" / "oracle_nprobe.csv")]
    assert best == sorted(best) and best[-1] == 1 and best[0] >= float(one["recall@k"]) - 1e-9
    assert all(float(r["gap"]) >= -1e-12 for r in _table(files / "o" / "oracle_branching_factor.csv"))


def test_dynamic_goes_on_where_it_ended(spark, files):
    some = ["dynamic", "--base", files / "base.fbin", "--queries", files / "queries.fbin", "--k", 5, "--out", files / "d", "--centers", 12, "--partitions", 3, "--m", 3, "--runbook", files / "book.yaml", "--key", "small", "--threshold", 12, "--mode", "NProbe", "--params", 3]
    _run(spark, *some)
    rows = _table(files / "d" / "results.csv")
    assert [r["step"] for r in rows] == ["1", "2", "3"] and float(rows[1]["recall"]) == 1 and int(rows[2]["remaining_tombstones"]) == 40
    assert [sum(int(r[f"shard_{p}_size"]) for p in range(3)) for r in rows] == [150, 150, 110]
    _run(spark, *some)  # nothing is left to do
    assert _table(files / "d" / "results.csv") == rows


def test_theory_from_state_files(spark, x, files):
    steps = runbook.load(spark, str(files / "book.yaml"), "small")
    base = x.vectors.where("vec_id < 200")
    found = simulate.centers_by_step(base, steps, x.router.where("cid < 12").select("cid", "cv", "cnt"), DIM).cache()
    parts = simulate.partitions_by_step(found, 3, degree=6).cache()
    (files / "states").mkdir()
    for s in (1, 3):
        states.write_centers(found.where(F.col("step") == s), str(files / "states"), s)
        states.write_partitions(parts.where(F.col("step") == s), str(files / "states"), s)
    some = ["theory", "--base", files / "base.fbin", "--queries", files / "queries.fbin", "--k", 5, "--runbook", files / "book.yaml", "--key", "small", "--states", files / "states", "--mode", "NProbe", "--params", 3]
    _run(spark, *some, "--out", files / "t", "--per-query-rankings")
    rows = _table(files / "t" / "theory_NProbe.csv")
    assert [r["step"] for r in rows] == ["1", "3"] and all(float(r["recall"]) == 1 for r in rows)
    best = _table(files / "t" / "bounds.csv")
    assert {r["kind"] for r in best} == {"NProbe", "RecallTarget"} and all(0 < float(r["recall"]) <= 1 for r in best)
    assert spark.read.parquet(str(files / "t" / "per_query_rankings")).count() == 24
    with pytest.raises(SystemExit):
        _run(spark, *some, "--out", files / "u", "--no-rebuilds", "--threshold", 0.5)
