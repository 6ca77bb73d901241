"""Every registered query equals its SQL twin on the smallest data, and plans no cartesian product."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_oracle import TABLES, rows  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from chatstream.plans.oracle import ORACLE  # noqa: E402
from chatstream.plans.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = rows(df.columns, df.collect())
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert ORACLE.items() <= entry_module.oracle_sql().items() and QUERIES.items() <= entry_module.queries().items()


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
