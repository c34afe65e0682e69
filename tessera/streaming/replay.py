"""Runbook replay, as a batch loop or a stream of step files, with checkpoints that it resumes from."""

from __future__ import annotations

import csv
import json
import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.index import Index
from tessera.operators import metrics, updates
from tessera.sources import runbook

CHECKPOINT_INTERVAL = 50


class Replay:
    """Applies steps to an index at `path`/index; a row of metrics for each goes to `path`/metrics.

    A step that was applied already (a stream may deliver it again) is passed over, told from the
    index's own step number, which is written together with the tables. search_scale repeats the queries
    so many times, search_fraction sets it so that searches are this share of all operations of the
    runbook; recall counts the queries themselves only.
    """

    def __init__(self, spark: SparkSession, base: DataFrame, queries: DataFrame, path: str, n_centers: int, blocks: int, threshold: int, k: int = 10, combos: list[tuple[str, float]] | None = None, degree: int = 32, interval: int = 6, checkpoint_every: int = CHECKPOINT_INTERVAL, strict: bool = False, search_scale: float = 1.0, search_fraction: float | None = None):
        self.spark, self.base, self.queries, self.path = spark, base, queries, path
        self.n_centers, self.blocks, self.threshold, self.k, self.degree, self.interval, self.strict = n_centers, blocks, threshold, k, degree, interval, strict
        self.combos = combos or [("BranchingFactor", 8), ("NProbe", 2), ("RecallTarget", 0.9)]
        self.checkpoint_every, self.scale, self.fraction = checkpoint_every, search_scale, search_fraction
        at = os.path.join(path, "index")
        if not os.path.exists(os.path.join(at, "CURRENT")) and (saved := latest_checkpoint(path)):
            shutil.copytree(saved, at, copy_function=_link)
        self.index = Index.load(spark, at) if os.path.exists(os.path.join(at, "CURRENT")) else None

    @property
    def step(self) -> int:
        return self.index.meta["step"] if self.index else 0

    def apply(self, step: int, operation: str, start: int | None, end: int | None) -> None:
        if step <= self.step:
            return
        began, rows, done = time.time(), [], {"rebuild": "none", "moved": 0, "elements_moved": 0}
        if self.index is None:
            if operation != "insert":
                raise ValueError("the first step must insert")
            self.index = Index.build(self._slice(start, end), os.path.join(self.path, "index"), self.n_centers, self.blocks, degree=self.degree)
            updated = time.time() - began
        else:
            self.index.timings = {}
            if operation == "insert":
                self.index.insert(self._slice(start, end))
            elif operation == "delete":
                self.index.delete(start, end, self.strict)
            updated = time.time() - began
            if operation in ("insert", "delete"):
                done = self.index.maintain(step, operation, self.threshold, self.interval, self.degree)
            elif operation == "search":
                rows = self._search()
        n = (end - start) / max(updated, 1e-9) if operation in ("insert", "delete") else None
        sizes = [r.live for r in self.index.shard_sizes().orderBy("pid").collect()]
        counts = self.index.counts().first()
        self._record(step, operation, start, end, updated, n, rows or [(None,) * 8], done, counts.current - counts.live, sizes)
        self.index.meta["step"] = step
        self.index._commit()
        if step % self.checkpoint_every == 0:
            self.checkpoint()

    def _search(self) -> list[tuple]:
        """A row of measures for each mode and parameter."""
        rows = []
        asked = self.queries if self.scale == 1 else updates.repeated_queries(self.queries, self.scale)
        truth = self.index.exact(self.queries, self.k).persist()
        n = asked.count()
        for mode, param in self.combos:
            at = time.time()
            routes = self.index.route(asked, mode, param).select("qid", "pid").persist()
            parts = metrics.avg_parts_searched(routes, n).first().avg_parts
            routed = time.time()
            found = self.index.search(asked, self.k, routes=routes).persist()
            found.count()
            seconds = time.time() - routed
            recall = metrics.recall_at_k(found, truth, self.k).first().recall
            theory = metrics.theoretical_recall(truth, self.index.vectors.where("not deleted"), routes, self.k).first().recall
            routes.unpersist()
            found.unpersist()
            rows.append((mode, float(param), n, recall, theory, parts, seconds, n / max(seconds, 1e-9)))
        truth.unpersist()
        return rows

    def _slice(self, start: int, end: int) -> DataFrame:
        return self.base.where((F.col("vec_id") >= start) & (F.col("vec_id") < end))

    def _record(self, step, operation, start, end, seconds, throughput, rows, done, tombstones, sizes) -> None:
        """A row for each mode and parameter; the times of a rebuild are null where there was none."""
        schema = (
            "step int, operation string, range_start bigint, range_end bigint, seconds double, update_throughput double, mode string, param double, queries bigint, recall double, theoretical_recall double, avg_parts double, search_seconds double, "
            "search_throughput double, search_fraction double, rebuild string, centers_moved bigint, elements_moved bigint, graph_s double, partition_s double, relabel_s double, rebuild_s double, remaining_tombstones bigint, shard_sizes array<bigint>"
        )
        took = [self.index.timings.get(k) for k in ("graph_s", "partition_s", "relabel_s", "rebuild_s")]
        out = self.spark.createDataFrame([(step, operation, start, end, seconds, throughput, *r, self.fraction, done["rebuild"], done["moved"], done["elements_moved"], *took, tombstones, sizes) for r in rows], schema)
        # overwriting its own folder makes a repeated step harmless
        out.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.path, "metrics", f"at={step:06d}"))

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, "metrics")).drop("at")

    def checkpoint(self) -> str:
        """The index as it is now: its files never change, so they are linked, not copied, where the file system can. The marker comes last, and then older ones go."""
        to = os.path.join(self.path, "checkpoints", f"s{self.step:06d}")
        shutil.rmtree(to, ignore_errors=True)
        shutil.copytree(os.path.join(self.path, "index"), to, copy_function=_link)
        with open(os.path.join(to, "COMMITTED"), "w") as f:
            json.dump({"step": self.step}, f)
        for d in os.listdir(os.path.dirname(to)):
            if d < os.path.basename(to):
                shutil.rmtree(os.path.join(os.path.dirname(to), d), ignore_errors=True)
        return to

    def run(self, steps: DataFrame) -> DataFrame:
        """All steps, in order, as a batch loop."""
        if self.fraction is not None:
            self.scale = updates.search_scale(steps, self.fraction, self.queries.count()).first().scale or 1.0
        for r in steps.orderBy("step").collect():  # a runbook, a few thousand rows at most
            self.apply(r.step, r.operation, r.start, r.end)
        return self.metrics()

    def stream(self, folder: str) -> DataFrame:
        """Steps from JSON files, one a micro-batch, in the order of their times, until all there are read."""
        steps = self.spark.readStream.schema(runbook.SCHEMA).option("maxFilesPerTrigger", 1).json(folder)

        def batch(df: DataFrame, _: int) -> None:
            for r in df.orderBy("step").collect():
                self.apply(r.step, r.operation, r.start, r.end)

        query = steps.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(self.path, "offsets")).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.metrics()


def _link(source: str, to: str) -> None:
    """A second name for a file; a copy of the pointer, which is written anew, and where links can't be made."""
    if os.path.basename(source) != "CURRENT":
        try:
            os.link(source, to)
            return
        except OSError:
            pass
    shutil.copy2(source, to)


def write_csv(rows: DataFrame, path: str) -> int:
    """The rows of `Replay.metrics` as one CSV file, a column for each shard's size; gives the number of rows."""
    got = rows.orderBy("step", "mode", "param").collect()  # a few rows a step
    names = [c for c in rows.columns if c != "shard_sizes"]
    shards = max((len(r.shard_sizes) for r in got), default=0)
    aside = path + ".new"
    with open(aside, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow([*names, *[f"shard_{i}_size" for i in range(shards)]])
        for r in got:
            out.writerow([-1 if r[c] is None else r[c] for c in names] + list(r.shard_sizes))
    os.replace(aside, path)
    return len(got)


def write_step_files(steps: DataFrame, folder: str) -> None:
    """One JSON file a step, with ascending times, for `Replay.stream`."""
    os.makedirs(folder, exist_ok=True)
    for i, r in enumerate(steps.orderBy("step").collect()):
        path = os.path.join(folder, f"{r.step:06d}.json")
        with open(path, "w") as f:
            json.dump({k: v for k, v in r.asDict().items() if v is not None}, f)
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))


def latest_checkpoint(path: str) -> str | None:
    """The last checkpoint that was committed."""
    at = os.path.join(path, "checkpoints")
    done = sorted(d for d in (os.listdir(at) if os.path.isdir(at) else []) if os.path.exists(os.path.join(at, d, "COMMITTED")))
    return os.path.join(at, done[-1]) if done else None
