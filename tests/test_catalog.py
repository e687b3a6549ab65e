"""The catalogue is consistent: every twin belongs to a query and every query builds its plan."""

import __spark_entry__ as contract
from drawbook.plans.registry import CATALOG


def test_twins_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(entry.operators for entry in CATALOG.values())


def test_flagship_runs(spark):
    assert contract.entry(spark).limit(5).count() == 5


def test_no_cartesian_product_in_core_plans(spark):
    for name in ("rollup_overall", "gate_rows", "lab_reported_build", "date_undated", "compare_subset", "table_rows"):
        plan = contract.queries()[name](spark, contract.SMOKE_FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
