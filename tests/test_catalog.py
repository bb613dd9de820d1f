"""Every registered query against its SQL on the smallest folder, and the shape of its plan."""

import pytest

from assayloom.catalog import all_queries, all_sql
from compare import differences, oracle_connection
from conftest import FOLDER

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0
        assert all(c for c in df.columns)


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert [r["al_round"] for r in rows] == [0, 1, 2, 3, 4, 5]
    assert set(e.queries()) >= set(QUERIES) and set(e.oracle_sql()) >= set(SQL)
