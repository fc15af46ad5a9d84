"""Every registered query runs at the smallest scale; those with SQL match DuckDB."""

import pytest
from check_queries import compare, open_duckdb

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    message, ok = compare(df, duck, SQL.get(name))
    assert ok, message


def test_entry(spark):
    assert E.entry(spark).count() > 0
