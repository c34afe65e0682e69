"""Binary vector formats as Spark data sources: fvecs, bvecs, i8bin, u8bin, fbin, and ground truth (ivecs, bin).

    register(spark)
    spark.read.format("vecs").option("start", 0).option("rows", 1000).load("/data/base.u8bin")
    spark.read.format("groundtruth").option("kind", "bin").load("/data/gt.bin")
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Suffix: (element type, whether each row begins with its dimension).
FORMATS = {".fvecs": (np.float32, True), ".bvecs": (np.uint8, True), ".i8bin": (np.int8, False), ".u8bin": (np.uint8, False), ".fbin": (np.float32, False)}
ROWS_PER_PARTITION, ROWS_PER_BATCH = 200_000, 20_000


def file_format(path: str) -> str:
    """The suffix that names the format; another one is an error."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown vector format: {path}")
    return suffix


def dataset_info(path: str) -> tuple[int, int]:
    """(rows, dimension) from the header and the file's size; an error if they don't fit."""
    kind, rowwise = FORMATS[file_format(path)]
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = np.frombuffer(f.read(8), "<i4")
    if len(head) < 1 + (not rowwise):
        raise ValueError(f"no header in {path}")
    if rowwise:
        dim = int(head[0])
        width = 4 + dim * np.dtype(kind).itemsize
        if dim <= 0 or size % width:
            raise ValueError(f"{path} doesn't hold whole rows of dimension {dim}")
        return size // width, dim
    n, dim = int(head.view("<u4")[0]), int(head.view("<u4")[1])
    if dim <= 0 or size != 8 + n * dim * np.dtype(kind).itemsize:
        raise ValueError(f"{path} doesn't hold {n} rows of dimension {dim}")
    return n, dim


def read_rows(path: str, start: int, rows: int) -> np.ndarray:
    """Rows start to start + rows (fewer at the end) as float32; a start beyond the end is an error."""
    kind, rowwise = FORMATS[file_format(path)]
    n, dim = dataset_info(path)
    if start < 0 or start > n or (start == n and n):
        raise ValueError(f"row {start} is beyond the {n} rows of {path}")
    rows = max(0, min(rows, n - start))
    width = dim * np.dtype(kind).itemsize + 4 * rowwise
    with open(path, "rb") as f:
        f.seek((0 if rowwise else 8) + start * width)
        raw = np.frombuffer(f.read(rows * width), np.uint8).reshape(rows, width)
    if rowwise:
        if (np.ascontiguousarray(raw[:, :4]).view("<i4") != dim).any():
            raise ValueError(f"rows of several dimensions in {path}")
        raw = raw[:, 4:]
    return np.ascontiguousarray(raw).view(np.dtype(kind).newbyteorder("<")).astype(np.float32)


def read_ground_truth(path: str, kind: str, start: int = 0, rows: int | None = None) -> np.ndarray:
    """Neighbour ids (queries x K). kind ivecs: rows begin with K; bin: header Q, K, then ids; distances after them aren't read."""
    with open(path, "rb") as f:
        head = np.frombuffer(f.read(8), "<u4")
        if len(head) < 1 + (kind == "bin"):
            raise ValueError(f"no header in {path}")
        size = os.path.getsize(path)
        if kind == "ivecs":
            k = int(head[0])
            width, lead = 4 + 4 * k, 0
            if k <= 0 or size % width:
                raise ValueError(f"{path} doesn't hold whole rows of {k} ids")
            q = size // width
        elif kind == "bin":
            q, k = int(head[0]), int(head[1])
            width, lead = 4 * k, 8
            if size < 8 + q * width:
                raise ValueError(f"{path} doesn't hold {q} rows of {k} ids")
        else:
            raise ValueError(f"unknown ground truth: {kind}")
        rows = max(0, min(q - start if rows is None else rows, q - start))
        f.seek(lead + start * width)
        ids = np.frombuffer(f.read(rows * width), "<u4").reshape(rows, -1)
    return ids[:, 1:] if kind == "ivecs" else ids


def ground_truth_kind(base: str) -> str:
    """What the ground truth of a base file is written as: by the base's format."""
    return "ivecs" if file_format(base) in (".fvecs", ".bvecs") else "bin"


class _Range(InputPartition):
    def __init__(self, start: int, rows: int):
        self.start, self.rows = start, rows


def _ranges(start: int, rows: int) -> list[_Range]:
    return [_Range(i, min(ROWS_PER_PARTITION, start + rows - i)) for i in range(start, start + rows, ROWS_PER_PARTITION)]


class _VecsReader(DataSourceReader):
    def __init__(self, path: str, start: int, rows: int | None):
        self.path, self.start = path, start
        n, _ = dataset_info(path)
        if start and start >= n:
            raise ValueError(f"row {start} is beyond the {n} rows of {path}")
        self.rows = n - start if rows is None else max(0, min(rows, n - start))

    def partitions(self) -> list[_Range]:
        return _ranges(self.start, self.rows) or [_Range(self.start, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])
        for i in range(partition.start, partition.start + partition.rows, ROWS_PER_BATCH):
            x = read_rows(self.path, i, min(ROWS_PER_BATCH, partition.start + partition.rows - i))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(x))), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], schema=schema)


class VecsSource(DataSource):
    """format("vecs"): (vec_id, embedding); vec_id is the row's place in the file. Options: start, rows."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return "vec_id bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        rows = self.options.get("rows")
        return _VecsReader(self.options["path"], int(self.options.get("start", 0)), None if rows is None else int(rows))


class _TruthReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind
        self.rows = len(read_ground_truth(path, kind))

    def partitions(self) -> list[_Range]:
        return _ranges(0, self.rows) or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        ids = read_ground_truth(self.path, self.kind, partition.start, partition.rows)
        q, k = ids.shape
        schema = pa.schema([("qid", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(partition.start, partition.start + q), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), q)), pa.array(ids.ravel().astype(np.int64))], schema=schema)


class GroundTruthSource(DataSource):
    """format("groundtruth"): (qid, rank, vec_id). Option kind: ivecs or bin."""

    @classmethod
    def name(cls) -> str:
        return "groundtruth"

    def schema(self) -> str:
        return "qid bigint, rank int, vec_id bigint"

    def reader(self, schema) -> DataSourceReader:
        return _TruthReader(self.options["path"], self.options.get("kind", "bin"))


def register(spark: SparkSession) -> None:
    for source in (VecsSource, GroundTruthSource):
        spark.dataSource.register(source)


def _ordinals(df: DataFrame, key: str) -> DataFrame:
    """df with `ordinal`, the place of each row in the order of key from 0: counts of ranges, and places within each range, so no task orders more than a range."""
    n = df.count()
    cuts = sorted(set(df.approxQuantile(key, [k / (r := -(-n // ROWS_PER_PARTITION)) for k in range(1, r)], 0.001))) if n > ROWS_PER_PARTITION else []
    bucket = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda x: x < F.col(key))) if cuts else F.lit(0)
    rows = df.withColumn("_bucket", bucket)
    counts = sorted(rows.groupBy("_bucket").count().collect())
    before = np.concatenate(([0], np.cumsum([c for _, c in counts]))).tolist()
    offsets = df.sparkSession.createDataFrame([(b, int(o)) for (b, _), o in zip(counts, before, strict=False)] or [(0, 0)], "_bucket int, _offset bigint")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return rows.withColumn("_place", place).join(F.broadcast(offsets), "_bucket").withColumn("ordinal", F.col("_place") + F.col("_offset")).drop("_bucket", "_place", "_offset")


def _write_rows(rows: DataFrame, path: str, head: bytes, width: int, lead: bytes, kind: type) -> None:
    """Writes rows (ordinal, values), each lead and its values, at their places in a file on a shared file system; tasks write side by side, and a repeated one writes the same."""
    aside = path + ".part"
    with open(aside, "wb") as f:
        f.write(head)
        f.truncate(len(head) + width * rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, at = 0, os.open(aside, os.O_WRONLY)
        try:
            for b in batches:
                x = np.array(b.column(1).to_pylist()) if not b.num_rows else np.stack(b.column(1).to_numpy(zero_copy_only=False))
                order = np.argsort(b.column(0).to_numpy())
                places = b.column(0).to_numpy()[order]
                data = np.ascontiguousarray(x[order]).astype(np.dtype(kind).newbyteorder("<")) if b.num_rows else x
                cut = np.flatnonzero(np.diff(places) != 1) + 1
                for i, j in zip([0, *cut], [*cut, len(places)], strict=True):
                    if j > i:
                        os.pwrite(at, b"".join(lead + r.tobytes() for r in data[i:j]), len(head) + width * int(places[i]))
                n += b.num_rows
        finally:
            os.close(at)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    os.replace(aside, path)


def write_vectors(vectors: DataFrame, path: str) -> int:
    """Writes vectors in order of vec_id as one file in the format of the path's suffix, on a mounted file system that all tasks reach."""
    kind, rowwise = FORMATS[file_format(path)]
    rows = vectors.select("vec_id", "embedding")
    got = rows.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.count_if(F.col("vec_id").isNull() | F.col("embedding").isNull()).alias("null")).first()
    if got.null or got.least != got.most:
        raise ValueError("null vectors or vectors of several dimensions")
    dim = got.most or 0
    head = b"" if rowwise else np.array([got.n, dim], "<u4").tobytes()
    _write_rows(_ordinals(rows, "vec_id").select("ordinal", "embedding"), path, head, dim * np.dtype(kind).itemsize + 4 * rowwise, np.array([dim], "<i4").tobytes() if rowwise else b"", kind)
    return got.n


def write_ground_truth(truth: DataFrame, path: str, kind: str = "bin") -> int:
    """Writes (qid, rank, vec_id) with as many neighbours for each query; queries count from 0 in order of qid."""
    if kind not in ("bin", "ivecs"):
        raise ValueError(f"unknown ground truth: {kind}")
    rows = truth.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))
    got = rows.agg(F.count("*").alias("n"), F.min(F.size("ids")).alias("least"), F.max(F.size("ids")).alias("most")).first()
    if got.least != got.most:
        raise ValueError("queries with several numbers of neighbours")
    k = got.most or 0
    head = b"" if kind == "ivecs" else np.array([got.n, k], "<u4").tobytes()
    _write_rows(_ordinals(rows, "qid").select("ordinal", "ids"), path, head, 4 * k + 4 * (kind == "ivecs"), np.array([k], "<u4").tobytes() if kind == "ivecs" else b"", np.uint32)
    return got.n


def truth_vectors(vectors: DataFrame, truth: DataFrame, path: str) -> DataFrame:
    """(vec_id, embedding) of all true neighbours, kept at path; made again where what is there holds another number of vectors than truth has ids."""
    spark, ids = truth.sparkSession, truth.select("vec_id").distinct()
    if not (os.path.exists(os.path.join(path, "_SUCCESS")) and spark.read.parquet(path).count() == ids.count()):
        vectors.select("vec_id", "embedding").join(ids, "vec_id", "left_semi").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def dump(values, path: str, kind: type = np.float32) -> int:
    """Raw little-endian numbers, as reports and plots read them; gives how many."""
    x = np.ascontiguousarray(values, np.dtype(kind).newbyteorder("<")).ravel()
    with open(path, "wb") as f:
        f.write(x.tobytes())
    return len(x)


def read_partition_map(path: str) -> np.ndarray:
    """A map from centroid to shard: its size in 8 bytes, then 4 bytes each."""
    raw = open(path, "rb").read()
    n = int(np.frombuffer(raw[:8], "<u8")[0]) if len(raw) >= 8 else -1
    if n < 0 or len(raw) != 8 + 4 * n:
        raise ValueError(f"{path} doesn't hold a partition map")
    return np.frombuffer(raw[8:], "<i4")


def write_partition_map(parts: np.ndarray, path: str) -> None:
    with open(path, "wb") as f:
        f.write(np.array([len(parts)], "<u8").tobytes() + np.asarray(parts, "<i4").tobytes())
