"""Binary formats and runbooks."""

import numpy as np
import pytest

from tessera.sources import runbook, vecs

X = np.arange(21).reshape(7, 3)


@pytest.fixture(params=sorted(vecs.FORMATS))
def suffix(request):
    return request.param


def _frame(spark, x=X):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")


def test_round_trip(spark, tmp_path, suffix):
    vecs.register(spark)
    path = str(tmp_path / f"x{suffix}")
    assert vecs.write_vectors(_frame(spark).repartition(3), path) == 7
    assert vecs.dataset_info(path) == (7, 3)
    got = {r.vec_id: list(r.embedding) for r in spark.read.format("vecs").load(path).collect()}
    assert got == {i: list(map(float, row)) for i, row in enumerate(X)}
    got = spark.read.format("vecs").option("start", 2).option("rows", 3).load(path).collect()
    assert sorted((r.vec_id, r.embedding[0]) for r in got) == [(2, 6.0), (3, 9.0), (4, 12.0)]
    assert len(vecs.read_rows(path, 5, 100)) == 2
    with pytest.raises(ValueError):
        vecs.read_rows(path, 7, 1)


def test_signed_and_unsigned_bytes(spark, tmp_path):
    x = np.array([[-128, 127], [0, -1]])
    vecs.write_vectors(_frame(spark, x), str(tmp_path / "x.i8bin"))
    assert vecs.read_rows(str(tmp_path / "x.i8bin"), 0, 9).tolist() == x.tolist()
    vecs.write_vectors(_frame(spark, x % 256), str(tmp_path / "x.u8bin"))
    assert vecs.read_rows(str(tmp_path / "x.u8bin"), 0, 9).tolist() == (x % 256).tolist()


def test_broken_files_are_errors(spark, tmp_path, suffix):
    path = tmp_path / f"x{suffix}"
    vecs.write_vectors(_frame(spark), str(path))
    raw = path.read_bytes()
    for bad in (raw[:-1], b"", raw[:3], np.array([0], "<i4").tobytes() + raw[4:] if vecs.FORMATS[suffix][1] else raw[:4] + np.array([5], "<u4").tobytes() + raw[8:]):
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            vecs.read_rows(str(path), 0, 1)
    with pytest.raises(ValueError):
        vecs.file_format("x.parquet")


@pytest.mark.parametrize("kind", ["bin", "ivecs"])
def test_ground_truth(spark, tmp_path, kind):
    vecs.register(spark)
    rows = [(q, r, 10 * q + r) for q in range(4) for r in (1, 2, 3)]
    path = str(tmp_path / "gt")
    vecs.write_ground_truth(spark.createDataFrame(rows, "qid bigint, rank int, vec_id bigint"), path, kind)
    got = spark.read.format("groundtruth").option("kind", kind).load(path).collect()
    assert sorted(map(tuple, got)) == rows
    with open(path, "ab") as f:
        f.write(b"\0" * 5)
    if kind == "bin":  # distances may follow
        assert len(vecs.read_ground_truth(path, kind)) == 4
    else:
        with pytest.raises(ValueError):
            vecs.read_ground_truth(path, kind)
    assert vecs.ground_truth_kind("a.fvecs") == "ivecs" and vecs.ground_truth_kind("a.u8bin") == "bin"


def test_partition_map(tmp_path):
    path = str(tmp_path / "p")
    vecs.write_partition_map(np.array([1, 0, 2]), path)
    assert vecs.read_partition_map(path).tolist() == [1, 0, 2]
    open(path, "ab").write(b"x")
    with pytest.raises(ValueError):
        vecs.read_partition_map(path)


def test_runbook(spark, tmp_path):
    text = "data:\n  max_pts: 500\n  10:\n    operation: search\n  1:\n    operation: insert\n    start: 0\n    end: 300\n  2:\n    operation: delete\n    start: 5\n    end: 9\n"
    assert runbook.parse(text, "data") == [(1, "insert", 0, 300), (2, "delete", 5, 9), (10, "search", None, None)]
    with pytest.raises(KeyError):
        runbook.parse(text, "other")
    (tmp_path / "a.yaml").write_text(text)
    steps = runbook.load(spark, str(tmp_path / "a.yaml"), "data")
    runbook.save(steps, str(tmp_path / "b.yaml"), "data")
    assert runbook.load(spark, str(tmp_path / "b.yaml"), "data").collect() == steps.collect()
    with pytest.raises(KeyError):
        runbook.Registry(a={}).files("b")
