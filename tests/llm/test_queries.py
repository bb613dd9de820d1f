"""Registered queries of the subpackage against their SQL, on the smallest folder."""

import pytest

from assayloom.llm.queries import llm_queries, llm_sql
from compare import differences, oracle_connection
from conftest import FOLDER


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_and_sql(spark, name):
    assert differences(llm_queries()[name](spark, FOLDER), oracle_connection(FOLDER), llm_sql()[name]) == []


def test_every_number_has_one_query():
    names = list(llm_queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    import __spark_entry__ as e

    assert set(names) | {"pipeline"} <= set(e.queries())


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_pii", "op5_reply_trees", "op7_license_scan"])
def test_native_plans_hold_no_python(spark, name):
    plan = llm_queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow")), plan
