"""The plans of the scores: generated methods that the JVM compiles, and gradients computed once."""

import re

import pytest

from cellgrove.plans import catalog

SMALL = "/root/testdata/sf0.001"


def _sizes(spark, df):
    df.collect()
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


@pytest.mark.parametrize("name", ["confusion", "model_scores", "f1_by_ndvi_band", "f1_by_slope_band", "f1_by_gradient", "preds"])
def test_methods_are_small_enough_to_be_compiled(spark, name):
    df = catalog.Views(spark, SMALL).preds() if name == "preds" else catalog.QUERIES[name](spark, SMALL)
    sizes = _sizes(spark, df)
    assert sizes and max(sizes) < 8000


def test_gradients_are_computed_once(spark):
    plan = catalog.QUERIES["f1_by_gradient"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "dr" not in re.findall(r"\w+", plan)  # no neighbours are exploded in the plan of the scores


@pytest.mark.parametrize("name", ["chunks_of_edges", "chunks_put_together", "window_isolation"])
def test_exploded_cells_are_never_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["smoothed_ce", "focal_loss", "task_weighting", "rule_penalties"])
def test_losses_join_no_cells(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner, (node_id" not in plan and "node_id" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_cells_are_marked_before_they_become_rows_by_profile(spark):
    plan = catalog.QUERIES["lidar_proximity_f1"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Cross") < plan.index("Join LeftOuter")  # the outer join lies below the cross join
