"""Plans of the operators: what must not be in them."""

import pytest

from folioflow.llm import QUERY_MODULES


@pytest.mark.parametrize("name", ["p6_found", "p8_ids", "p10_found", "p5_found"])
def test_one_pass_queries_have_no_exchange(spark, sf_dir, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Exchange hashpartitioning" not in plan and "PushedFilters" in plan


def test_every_module_has_queries_and_sql_of_the_same_names():
    for m in QUERY_MODULES:
        module = __import__(f"folioflow.llm.{m}", fromlist=["QUERIES"])
        assert set(module.ORACLE) <= set(module.QUERIES) and module.QUERIES
