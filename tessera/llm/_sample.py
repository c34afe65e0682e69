"""Bounded samples of rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _shared


def least_hashes(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """The `rows` rows of ids (doc_id, ...) whose hash of doc_id is least, ties by doc_id; doc_id is distinct and not null.

    Rows above a hash that twice as many lie under on average are left out first, so that what one task
    orders doesn't grow with the number of tasks.
    """
    h, n = F.xxhash64("doc_id", F.lit(seed)), ids.count()
    if n > 4 * (rows + 1000):
        some = ids.where(h < int(-(2**63) + 2**64 * (2 * rows + 1000) / n))
        if some.count() >= rows:
            ids = some
    return ids.orderBy(h, "doc_id").limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """(doc_id, text, label): the texts of at most `rows` labelled documents, taken in the order of a hash of doc_id.

    One row per doc_id (its greatest label, its least text); null ids, labels and texts are left out.
    """
    some = labels.select("doc_id", F.col(label).alias("label")).where("doc_id is not null and label is not null")
    some = _shared.materialize(least_hashes(some.groupBy("doc_id").agg(F.max("label").alias("label")), rows, seed), "sample")
    return docs.select("doc_id", "text").where("text is not null").join(_shared.small(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
