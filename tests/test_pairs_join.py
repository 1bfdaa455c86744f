import pytest

from tesselade.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bleu1_pairs", "rouge_l_pairs", "meteor_pairs", "explanatory_metrics"])
def test_pairs_are_never_broadcast(spark, name):
    """Token arrays are far larger than their estimate; no table of them may go through the driver."""
    df = catalog.queries()[name](spark, SF)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_only_pairs_are_tokenized(spark):
    """Gold rows without a prediction reach the join as they are stored."""
    plan = catalog.queries()["meteor_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan.split("Join Inner")[0] and "regexp_extract_all" not in plan.split("Join Inner")[1]
