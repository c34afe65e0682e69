"""Runbooks: ordered steps of inserts, deletes and searches, from YAML; and the registry of datasets."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "step int, operation string, start bigint, end bigint"


def parse(text: str, key: str) -> list[tuple[int, str, int | None, int | None]]:
    """(step, operation, start, end) in order of the step, of one dataset's runbook. Keys that aren't numbers tell other things; end is exclusive."""
    book = (yaml.safe_load(text) or {}).get(key)
    if book is None:
        raise KeyError(f"no runbook {key}")
    return [(int(n), s["operation"], s.get("start"), s.get("end")) for n, s in sorted(((n, s) for n, s in book.items() if str(n).isdigit()), key=lambda x: int(x[0]))]


def load(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The runbook as rows of SCHEMA."""
    with open(path) as f:
        return spark.createDataFrame(parse(f.read(), key), SCHEMA)


def save(steps: DataFrame, path: str, key: str) -> None:
    """Writes a runbook (a few thousand steps at most) as YAML."""
    book = {r.step: {"operation": r.operation} | ({} if r.start is None else {"start": r.start, "end": r.end}) for r in steps.collect()}
    with open(path, "w") as f:
        yaml.safe_dump({key: book}, f)


class Registry(dict):
    """Dataset key to its files: base, query, runbook, gt."""

    def files(self, key: str) -> dict[str, str]:
        if key not in self:
            raise KeyError(f"no dataset {key}; known: {', '.join(sorted(self))}")
        return self[key]
