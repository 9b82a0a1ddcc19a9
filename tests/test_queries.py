"""Every registered query that has check SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from toolwarden.plans import catalog

from .conftest import DATA


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return db


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: [(v is None, str(v)) for v in r]
    return sorted(([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order] for r in values), key=key)


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_query(spark, con, name):
    df = entry_module.queries()[name](spark, DATA)
    want = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["scan_id", "score", "grade", "capped"] and df.count() > 0
