"""Physical plans: no nested loops, no Python on the hot path, pruned scans."""

import os

import pytest

from canloom.plans import job_queries, log_queries, queries  # noqa: F401
from canloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
#: One row by one row, or the few channels of the bindings by each log.
SCALAR = {"axis_contract", "compare_statistics", "fleet_summary", "log_converted_twice"}
#: Logs as rows of bytes are parsed in Arrow batches.
ARROW = {"log_remote_store"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_plan(spark, name):
    plan = plan_of(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "EvalPython" not in plan and "FlatMapGroups" not in plan
    assert "MapInArrow" not in plan or name in ARROW
    assert "BroadcastNestedLoopJoin" not in plan or name in SCALAR


def test_scans_are_pruned(spark):
    plan = plan_of(registry.queries()["channels_distinct"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint>" in plan
    plan = plan_of(registry.queries()["batch_outcomes"](spark, SF))
    assert "o_totalprice" not in plan
    plan = plan_of(registry.queries()["mapping_parse"](spark, SF))
    assert "PushedFilters" in plan and "c_acctbal" not in plan


def test_classification_is_a_broadcast(spark):
    plan = plan_of(registry.queries()["frames_classify"](spark, SF))
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_statistics_shuffle_buckets_alone(spark):
    """Frames are aggregated before the exchange: what is dealt by key has counts, not times."""
    plan = plan_of(registry.queries()["bus_stats_counts"](spark, SF))
    assert "partial_count" in plan and "SortMergeJoin" not in plan.split("Window")[0]
