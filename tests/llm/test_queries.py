import pytest

from tesselade.llm import catalog
from tests.compare import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    assert spark_rows(catalog.queries()[name](spark, SF)) == sql_rows(catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan_has_no_nested_loop_or_row_udf(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if x in plan]
