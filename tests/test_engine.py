"""Invariants of the index: search, updates, maintenance, replay."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import simulate
from tessera.functions import kernels
from tessera.index import Index
from tessera.operators import bounds, clustering, graph, maintenance, metrics, nearest, partitioner, routing, updates
from tessera.plans.registry import BLOCKS, DIM, QUERIES, RUNBOOK, Fixtures, _damaged
from tessera.streaming import replay

K = 10


@pytest.fixture(scope="module")
def x(spark):
    return Fixtures(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def placed(x):
    return x.placed().cache()


@pytest.fixture(scope="module")
def truth(x):
    return nearest.exact_knn(x.vectors, x.queries, K, exclude_self=False).cache()


def test_kernel_is_brute_force():
    rng = np.random.default_rng(0)
    q, v = rng.integers(-2, 3, (40, 6)).astype(float), rng.integers(-2, 3, (300, 6)).astype(float)
    ids = rng.permutation(300)
    r, c, d = kernels.nearest(q, v, ids, 7, own=np.arange(40))
    for i in range(40):
        want = sorted((((q[i] - v[j]) ** 2).sum(), ids[j]) for j in range(300) if ids[j] != i)[:7]
        assert [(a, ids[b]) for a, b in zip(d[r == i], c[r == i], strict=True)] == want
    assert len(kernels.nearest(q, v[:3], ids[:3], 7)[0]) == 120 and not len(kernels.nearest(q, v[:0], ids[:0], 7)[0])


def _peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_kernel_memory_is_bounded():
    same, q = np.ones((2000, 64)), np.zeros((500, 64))
    assert _peak_mb(lambda: kernels.nearest(q, same, np.arange(2000), 10)) < 200  # all are equally near, so all are candidates
    rng = np.random.default_rng(3)
    elements = pa.array(rng.random(20_000 * 64), mask=rng.random(20_000 * 64) < 1e-4)
    column = pa.ListArray.from_arrays(np.arange(0, 20_000 * 64 + 1, 64, dtype=np.int32), elements)
    parts = list(kernels.pieces(iter([pa.RecordBatch.from_arrays([column], ["v"])])))
    got = [kernels.usable(b.column(0), 64) for b in parts]
    starts = np.cumsum([0, *[b.num_rows for b in parts]])
    whole, rows = kernels.usable(column, 64)
    assert max(b.num_rows for b in parts) <= kernels.ROWS and (np.concatenate([g[0] for g in got]) == whole).all()
    assert 0 < len(rows) < 20_000 and np.concatenate([g[1] + i for g, i in zip(got, starts, strict=False)]).tolist() == rows.tolist()
    assert _peak_mb(lambda: [kernels.usable(b.column(0), 64) for b in parts[-1:]]) < 10


@pytest.mark.parametrize("mode,param", [("BranchingFactor", 3), ("NProbe", 1), ("NProbe", BLOCKS), ("RecallTarget", 0.9), ("RecallTarget", 0.0), ("RecallTarget", 1.0), ("RecallTargetExtended", 0.9)])
def test_recall_is_the_theoretical_one(x, placed, truth, mode, param):
    routes = routing.route(x.queries, x.router, mode, param, DIM)
    found = routing.search(placed, x.queries, routes, K)
    real = metrics.recall_at_k(found, truth, K).first().recall
    assert real == metrics.theoretical_recall(truth, placed, routes, K).first().recall
    assert mode != "NProbe" or param != BLOCKS or real == 1
    assert routes.select("qid").distinct().count() == 50


def test_recall_grows_and_stays_below_the_bounds(x, placed, truth):
    shares = bounds.neighbour_shares(truth, placed, K, BLOCKS).cache()
    best = {r.nprobe: r.mean_recall for r in bounds.nprobe(shares, K, BLOCKS).collect()}
    recall = lambda mode, p: metrics.theoretical_recall(truth, placed, routing.route(x.queries, x.router, mode, p), K).first().recall
    probes = [recall("NProbe", p) for p in range(1, BLOCKS + 1)]
    assert probes == sorted(probes) and all(p <= best[i + 1] + 1e-12 for i, p in enumerate(probes))
    branch = [recall("BranchingFactor", b) for b in (1, 4, 16, 100)]
    target = [recall("RecallTarget", t) for t in (0.0, 0.5, 0.9, 1.0)]
    assert branch == sorted(branch) and target == sorted(target)
    row = bounds.branching_factor(shares, routing.branching_factor(x.queries, x.router, 4), K).first()
    assert row.actual <= row.best and row.gap >= 0
    with pytest.raises(ValueError):
        routing.route(x.queries, x.router, "Other", 1)


def test_many_queries_go_in_slices(x, placed, monkeypatch):
    whole = nearest.exact_knn(x.vectors, x.queries, 3).collect()
    monkeypatch.setattr(nearest, "QUERY_SLICE", 20)
    assert sorted(nearest.exact_knn(x.vectors, x.queries, 3).collect()) == sorted(whole)
    with pytest.raises(ValueError):
        nearest.Table(x.queries, "qid", "qv", 10)
    # queries of another dimension than most of them are left out, of either number
    odd = x.queries.withColumn("qv", F.expr("if(qid % 5 = 0, slice(qv, 1, 3), qv)"))
    want = sorted(r for r in whole if r.qid % 5)
    assert sorted(nearest.exact_knn(x.vectors, odd, 3).collect()) == want
    monkeypatch.setattr(nearest, "QUERY_SLICE", 60)
    assert sorted(nearest.exact_knn(x.vectors, odd, 3).collect()) == want
    with pytest.raises(ValueError):
        nearest.Table(odd, "qid", "qv", 60)


def test_only_routed_shards_are_read(spark, x, placed, tmp_path):
    placed.select("vec_id", "embedding", "pid").write.partitionBy("pid").parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    one = x.queries.limit(1)
    routes = routing.nprobe(one, x.router, 1)
    plan = nearest.scan_topk(stored, one, K, routes)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [pid" in plan.replace("isnotnull(pid#", "pid") or "PartitionFilters: [isnotnull(pid" in plan or "pid" in plan.split("PartitionFilters")[1][:80]


@pytest.mark.parametrize("name,passes", [("search_nprobe", 1), ("search_branching_factor", 1), ("search_recall_target", 1), ("local_topk", 1), ("recall_at_k", 2)])
def test_search_goes_through_one_python_worker(spark, sf, name, passes):
    # recall_at_k also scans for the true neighbours
    assert QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == passes


def test_search_places_like_the_index(spark, x, placed, monkeypatch):
    routes = routing.nprobe(x.queries, x.router, 2)
    found = lambda f, vectors, router=None: sorted(f(vectors, x.queries, routes, K, True, router).collect())
    damaged = _damaged(x)
    for f in (routing.search, routing.local_topk):
        assert found(f, x.vectors, x.router) == found(f, placed)
        assert found(f, damaged, x.router) == found(f, routing.place(damaged, x.router, ("embedding",)))
    live = x.vectors.withColumn("deleted", F.col("vec_id") % 3 == 0)
    assert found(routing.search, live, x.router) == found(routing.search, placed.where("vec_id % 3 <> 0"))
    short = x.router.withColumn("cv", F.slice("cv", 1, 5))
    assert not found(routing.search, x.vectors, short) and not found(routing.search, x.vectors, x.router.where("false"))
    want = found(routing.search, placed)
    monkeypatch.setattr(nearest, "QUERY_SLICE", 20)
    assert found(routing.search, x.vectors, x.router) == want


@pytest.mark.parametrize("weighted", [False, True])
def test_partition_is_balanced_and_cuts_little(weighted):
    rng = np.random.default_rng(1)
    n, blocks = 200, 4
    group = np.arange(n) % blocks
    src, dst = rng.integers(0, n, (2, 1500))
    near = (group[src] == group[dst]) | (rng.random(1500) < 0.05)
    src, dst = src[near], dst[near]
    load = rng.integers(1, 9, n) if weighted else None
    block = partitioner.partition(n, src, dst, blocks, node_weight=load)
    size = np.bincount(block, weights=load, minlength=blocks)
    assert size.max() <= np.ceil(1.03 * size.sum() / blocks)
    assert (block[src] != block[dst]).mean() < 0.5 * (rng.permutation(block)[src] != block[dst]).mean()
    assert (partitioner.partition(n, src, dst, 1) == 0).all()
    assert sorted(np.bincount(partitioner.partition(3, src[:0], dst[:0], 3))) == [1, 1, 1]


@pytest.mark.parametrize("n", range(1, 7))
def test_matching_is_the_best(n):
    rng = np.random.default_rng(n)
    for _ in range(10):
        score = rng.integers(0, 9, (n, n))
        got = partitioner.match(score)
        assert sorted(got) == list(range(n))
        assert score[np.arange(n), got].sum() == max(sum(score[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_drift_ignores_names():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, (2, 60))
    assert partitioner.drift(a, a, 5) == 0 and partitioner.drift(rng.permutation(5)[a], a, 5) == 0
    assert partitioner.drift(a, b, 5) == pytest.approx(partitioner.drift(rng.permutation(5)[a], b, 5))


def test_kmeans(x):
    got = clustering.kmeans(x.vectors, 10, restarts=2)
    assert got.count() == 10 and got.agg(F.sum("cnt")).first()[0] == 0
    fitted = clustering.inertia(x.vectors, got).first().inertia
    assert fitted < clustering.inertia(x.vectors, x.router.where("cid < 10")).first().inertia
    again = clustering.kmeans(x.vectors, 10, restarts=2)
    assert clustering.inertia(x.vectors, again).first().inertia == pytest.approx(fitted)
    centers, last, _ = clustering.lloyd(x.vectors, np.array([[0.0] * DIM, [9.0] * DIM]), 50)
    assert (centers[1] == 9).all() and last < 50  # nobody joins the second
    assert clustering.lloyd(x.vectors, np.zeros((0, DIM)))[1] == -1


def test_need_rebuild_and_decision():
    need = maintenance.need_rebuild
    assert [need(5, 10, 3, 100), need(10, 10, 3, 100), need(2, 10, 3, 100), need(50, 100, 3, 100), need(50, 10, 100, 100)] == [2, 1, 0, 0, 0]
    d = maintenance.decision
    assert [d(6, "insert", 9, 5, 40, 0.1), d(5, "insert", 9, 5, 40, 0.1), d(6, "search", 9, 5, 40, 0.9), d(12, "delete", 0, 5, 40, 0.5), d(6, "insert", 9, 40, 40, 0.9), d(6, "insert", 4, 5, 40, 0.1)] == ["delta", "none", "none", "full", "none", "none"]


def _means_hold(index):
    live = {}
    for r in index.vectors.where("not deleted").collect():
        live.setdefault(r.cid, []).append(r.embedding)
    centers = {r.cid: r for r in index.centers.collect()}
    for cid, c in centers.items():
        assert c.cnt == len(live.get(cid, []))
        if c.cnt:
            assert np.allclose(c.cv, np.mean(live[cid], axis=0), atol=1e-9)


def test_index_life(spark, x, tmp_path):
    base = x.vectors.select("vec_id", "embedding")
    index = Index.build(base.where("vec_id < 300"), str(tmp_path / "i"), 20, BLOCKS, degree=8)
    _means_hold(index)
    index.validate()
    sizes = np.bincount([r.pid for r in index.router.collect()], minlength=BLOCKS)
    assert sizes.max() <= np.ceil(1.03 * 20 / BLOCKS)
    index.insert(base.where("vec_id between 290 and 399"))
    index.delete(50, 120)
    index.delete(90, 130)
    with pytest.raises(ValueError):
        index.delete(100, 101, strict=True)
    _means_hold(index)
    index.validate()
    assert index.counts().first().live == 400 - 80
    found = index.search(x.queries, K, "NProbe", BLOCKS)
    assert sorted(found.collect()) == sorted(index.exact(x.queries, K).collect())
    index.save(str(tmp_path / "copy"))
    copy = Index.load(spark, str(tmp_path / "copy"))
    new = index.repartition(degree=8)
    index.rebuild(new, full=False)
    copy.rebuild(new, full=True)
    live = lambda i: sorted((r.vec_id, r.cid, r.pid) for r in i.vectors.where("not deleted").collect())
    assert live(index) == live(copy) and copy.counts().first().current == 320
    _means_hold(copy)
    assert sorted(copy.search(x.queries, K, "NProbe", BLOCKS).collect()) == sorted(found.collect())
    with pytest.raises(ValueError):
        Index.build(base, str(tmp_path / "z"), 4, 2, assignments=base)


def _replay(spark, x, path, **options):
    return replay.Replay(spark, x.vectors.select("vec_id", "embedding"), x.queries.limit(10), str(path), 12, 3, threshold=1, degree=6, combos=[("NProbe", 1)], interval=2, checkpoint_every=3, **options)


def _state(run):
    return sorted((r.vec_id, r.cid, r.pid, r.deleted) for r in run.index.vectors.collect())


def test_stream_and_resume_equal_the_batch(spark, x, tmp_path):
    steps = x.steps.where("step <= 4")
    batch = _replay(spark, x, tmp_path / "a")
    rows = batch.run(steps).orderBy("step").collect()
    assert [r.step for r in rows] == [1, 2, 3, 4] and rows[1].recall == rows[1].theoretical_recall and len(rows[0].shard_sizes) == 3
    replay.write_step_files(steps, str(tmp_path / "steps"))
    stream = _replay(spark, x, tmp_path / "b")
    assert [r.recall for r in stream.stream(str(tmp_path / "steps")).orderBy("step").collect()] == [r.recall for r in rows]
    assert _state(stream) == _state(batch)
    _replay(spark, x, tmp_path / "c").run(steps.where("step <= 3"))
    (tmp_path / "c" / "index" / "CURRENT").unlink()
    import shutil

    shutil.rmtree(tmp_path / "c" / "index")
    again = _replay(spark, x, tmp_path / "c")
    assert again.step == 3
    again.run(steps)
    assert _state(again) == _state(batch)
    with pytest.raises(ValueError):
        _replay(spark, x, tmp_path / "d").run(steps.where("step = 2"))


def test_simulation(spark, x):
    steps = x.steps.where("step in (1, 3, 4)")
    centers = x.router.where("cid < 12").select("cid", "cv", "cnt")
    states = simulate.centers_by_step(x.vectors, steps, centers, DIM).cache()
    live = {1: 300, 3: 230, 4: 330}
    assert {r.step: r.n for r in states.groupBy("step").agg(F.sum("cnt").alias("n")).collect()} == live
    parts = simulate.partitions_by_step(states, 3, degree=6).cache()
    assert parts.count() == 36 and all(r.pid in range(3) for r in parts.collect())
    for tau in (None, 0.0, 1.0):
        rows = simulate.recall_by_step(x.vectors, x.queries.limit(5), x.steps, states, parts, 3, 5, "NProbe", 2, DIM, tau=tau)
        assert [r["step"] for r in rows] == [1, 3, 4] and all(0 < r["recall"] <= 1 and r["activation"] == pytest.approx(2 / 3) for r in rows)
        assert tau != 1.0 or {r["active_step"] for r in rows} == {1}
    every = simulate.recall_by_step(x.vectors, x.queries.limit(5), x.steps, states, parts, 3, 5, "NProbe", 3, DIM)
    assert all(r["recall"] == 1 for r in every)


def test_graph_modes(x):
    edges = x.graph()
    all_ = graph.base_layer_edges(x.counted(), edges).count()
    empty = x.counted().withColumn("cnt", F.when(F.col("cid") < 5, 0).otherwise(F.col("cnt")))
    assert graph.base_layer_edges(empty, edges, "skip_nodes").count() < all_
    assert graph.base_layer_edges(x.counted(), edges.withColumn("d", F.lit(0.0))).count() == 0
    with pytest.raises(ValueError):
        graph.base_layer_edges(x.counted(), edges, "x")


def test_updates_edges(spark, x, placed):
    one = spark.createDataFrame([(0, [1.0] * DIM, 1), (1, [5.0] * DIM, 0)], "cid int, cv array<double>, cnt bigint")
    row = spark.createDataFrame([(0, [1.0] * DIM), (1, [2.0] * DIM)], "cid int, embedding array<double>")
    gone = {r.cid: r for r in updates.centers_after_delete(one, row.where("cid = 0"), DIM).collect()}
    assert gone[0].cnt == 0 and gone[0].cv == [1.0] * DIM
    put = {r.cid: r for r in updates.centers_after_insert(one, row, DIM).collect()}
    assert put[1].cv == [2.0] * DIM and put[1].cnt == 1 and put[0].cnt == 2
    with pytest.raises(ValueError):
        updates.search_scale(x.steps, 1.0, 5)
    assert [s for s, *_ in RUNBOOK] == list(range(1, 10))


def test_sweeps(spark, x, placed, truth, tmp_path):
    from tessera import sweeps

    index = Index.from_tables(x.router, x.counted(), placed.withColumn("deleted", F.lit(False)), str(tmp_path / "i"), DIM, BLOCKS)
    grid = {"NProbe": [1, BLOCKS], "RecallTarget": [0.9]}
    rows, loads = sweeps.search_sweep(index, x.queries, truth, K, grid, runs=1)
    got = {(r.mode, r.param): r for r in rows.collect()}
    assert got["NProbe", BLOCKS].recall == 1 and got["NProbe", 1].avg_parts == 1 and all(r.qps > 0 for r in got.values())
    assert metrics.hot_shard_summary(loads, BLOCKS).agg(F.sum("times_hottest")).first()[0] == 3
    quality = {(r.mode, r.param): r for r in sweeps.partitioning_quality(x.vectors, x.queries, truth, x.router, BLOCKS, K, DIM, grid).collect()}
    assert all(quality[key].recall == pytest.approx(got[key].recall) for key in got)
    assert quality["NProbe", 1].bound >= quality["NProbe", 1].recall
