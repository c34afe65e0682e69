"""Every query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tessera.plans import registry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    return con


def _rows(table):
    names = sorted(table.column_names)
    return [str(table.schema.field(c).type).replace("large_", "") for c in names], sorted(map(repr, zip(*[table.column(c).to_pylist() for c in names], strict=True)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.01").toArrow()
    assert got.num_rows
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__ as engine

    assert engine.entry(spark).count() == 1
    assert set(engine.oracle_sql()) <= set(engine.queries()) and set(registry.QUERIES) <= set(engine.queries())
    assert os.path.exists("/root/testdata/sf0.001")
