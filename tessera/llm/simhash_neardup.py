"""Operator 8, SimHash near-duplicates: random bit sampling finds candidates, Hamming distance decides.

Each table samples `planned()[0]` of the fingerprint's 256 coordinates; documents that agree on them
share a bucket. Buckets above `cap` rows are split by further sampled coordinates; what is still above
it (dense clusters) is compared in full, in square tiles that spread over tasks. In every bucket all
pairs are verified. The number of tables follows the corpus size, so recall at the radius stays level
as it grows; the further bits of split buckets are not counted in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _shared, _text

BITS = 256
#: Documents within this Hamming distance are near copies (unrelated ones lie around 115).
RADIUS = 60
#: Pairs at this distance are found with probability RECALL, closer ones more often.
DESIGN_DISTANCE, RECALL = RADIUS, 0.95
#: Rows that a bucket of unrelated documents holds on average, and the most before it is split.
BUCKET, CAP = 512, 2048


def planned(n: int, bucket: int = BUCKET, distance: int = DESIGN_DISTANCE) -> tuple[int, int]:
    """(sampled bits, tables) for n distinct fingerprints; bits are sampled without replacement."""
    bits = max(1, math.ceil(math.log2(max(2.0, n / bucket))))
    hit = math.comb(BITS - distance, bits) / math.comb(BITS, bits)
    return bits, max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))) if hit < 1 else 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of the documents that have an id and a text that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.parts(batches):
            data, offsets, null = _text.column_buffers(b.column(1))
            fp, has = _text.simhash(data, offsets, BITS)
            has &= ~null
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(has)), _text.binary_rows(fp[has])], ["doc_id", "fp"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, fp binary")


def _keys(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(t, key, ext, doc_id, fp): for each table the sampled bits, and 16 more to split large buckets by."""
    rng = np.random.default_rng(seed)
    picks = [rng.permutation(BITS)[: bits + 16] for _ in range(tables)]
    place = (1 << np.arange(63, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.parts(batches):
            flags = np.unpackbits(_text.rows_of_binary(part.column(1), BITS // 8), axis=1)
            for t, pick in enumerate(picks):
                key, ext = flags[:, pick[:bits]] @ place[:bits], flags[:, pick[bits:]] @ place[:16]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), pa.array(ext.astype(np.int32)), part.column(0), part.column(1)], ["t", "key", "ext", "doc_id", "fp"])

    return reps.select("doc_id", "fp").mapInArrow(run, "t int, key bigint, ext int, doc_id bigint, fp binary")


def forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each row of uint64 words the least row that it is connected to by pairs within the radius."""
    n = len(fp)
    label = np.arange(n)
    cols = [np.ascontiguousarray(fp[:, w]) for w in range(fp.shape[1])]
    step = max(1, (1 << 18) // max(n, 1))
    for i in range(0, n, step):
        far = np.zeros((min(step, n - i), n - i), np.uint16)
        for c in cols:
            far += np.bitwise_count(c[i : i + step, None] ^ c[None, i:])
        a, b = np.nonzero(far <= radius)
        a, b = label[a + i], label[b + i]
        apart = a != b
        if not apart.any():
            continue
        root = np.arange(n)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for pair in np.unique(a[apart] * n + b[apart]):
            x, y = find(int(pair // n)), find(int(pair % n))
            root[max(x, y)] = min(x, y)
        while (root != root[root]).any():
            root = root[root]
        label = root[label]
    return label


def _bucket_edges(radius: int):
    def run(bucket: pa.Table) -> pa.Table:
        ids = bucket.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        label = forest(_text.rows_of_binary(bucket.column("fp"), BITS // 8).view(np.uint64)[order], radius)
        more = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[label[more]], "b": ids[more]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def candidate_edges(reps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, cap: int = CAP, seed: int = 7) -> DataFrame:
    """Edges (a, b) that span, bucket by bucket, what the pairs within the radius connect."""
    bits, tables = planned(reps.count(), bucket, radius)
    keyed = _keys(reps, bits, tables, seed)
    where = ["t", "key", "sub", "i", "j"]
    none = [F.lit(0).alias("sub"), F.lit(0).alias("i"), F.lit(0).alias("j")]
    over = _shared.materialize(keyed.groupBy("t", "key").count().where(F.col("count") > cap), "over")
    if not (n := over.count()):
        parts = keyed.select("t", "key", *none, "doc_id", "fp")
    else:
        # one more bit halves a bucket of unrelated rows; two to spare for uneven ones
        more = F.least(F.lit(16), F.ceil(F.log2(F.col("count") / cap)) + 2).cast("int")
        over = _shared.small(over.select("t", "key", more.alias("more")), n)
        split = keyed.join(over, ["t", "key"], "left").withColumn("sub", F.when(F.col("more").isNull(), -1).otherwise(F.col("ext").bitwiseAND(F.expr("shiftleft(1, more) - 1"))))
        dense = _shared.materialize(split.where("sub >= 0").groupBy("t", "key", "sub").count().where(F.col("count") > cap).select("t", "key", "sub", F.ceil(F.col("count") / cap).cast("int").alias("blocks")), "dense")
        tiled = split.join(_shared.small(dense), ["t", "key", "sub"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
        parts = tiled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", "key", "sub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "fp")
    return parts.groupBy(*where).applyInArrow(_bucket_edges(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, cap: int = CAP, seed: int = 7) -> DataFrame:
    """Groups of near copies: (doc_id, group_id, keep), one row per distinct doc_id that isn't null.

    group_id is the least doc_id of the group, the one that is kept. Groups are the components of the
    pairs within `radius`. Null and blank texts are compared with nothing: each is its own group.
    Several rows of one doc_id count as one document, with the least of their fingerprints. Texts of any
    length count whole. An empty table gives an empty result; other columns are not looked at.
    """
    print_ = _shared.materialize(fingerprints(docs).groupBy("doc_id").agg(F.min("fp").alias("fp")), "fingerprints")
    same = print_.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = _shared.materialize(same.select(F.col("rep").alias("doc_id"), "fp"), "reps")
    parts = _shared.connected_components(candidate_edges(reps, radius, bucket, cap, seed))
    groups = reps.join(parts, reps.doc_id == parts.node, "left").select("fp", F.coalesce("component", "doc_id").alias("group_id"))
    found = print_.join(groups, "fp").select("doc_id", "group_id")
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), (F.coalesce("group_id", "doc_id") == F.col("doc_id")).alias("keep"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near copies, in their own columns.

    Of several rows of one doc_id one stays (the least text). Rows with a null doc_id all stay.
    """
    gone = _shared.materialize(near_duplicates(docs, **options).where("not keep").select("doc_id"), "gone")
    again = _shared.materialize(docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    kept = docs.join(_shared.small(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    again = _shared.small(again)
    rows = kept.join(again, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    one = rows.groupBy("doc_id").agg(F.min_by("row", F.struct(F.col("text").isNull(), "text")).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(one)
