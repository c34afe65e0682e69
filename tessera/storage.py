"""The folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir (a mounted folder); where that is unset, in a temporary one, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return os.path.join(at.removeprefix("file://"), f"{name}-{uuid.uuid4().hex}")
