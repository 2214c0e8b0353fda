"""Plan-shape regressions: the scale properties the design relies on."""

from __future__ import annotations

import re

import pytest

from conftest import SF001
import __spark_entry__ as entry


def physical(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan shape
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # plan as at scale
    try:
        return entry.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(plan):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)


def test_sessions_shuffle_rows_once(spark):
    plan = physical(spark, "sessions")
    assert len(exchanges(plan)) == 2  # rows by (player, day), fragments by player
    assert plan.count("FileScan") == 1
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["retention", "funnel", "cohort_retention", "anomalies"])
def test_no_nested_loop_or_cartesian_joins(spark, name):
    plan = physical(spark, name)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_scans_are_pruned(spark):
    plan = physical(spark, "retention")
    for schema in re.findall(r"ReadSchema: (struct<[^>]*>)", plan):
        assert "value" not in schema and "props" not in schema  # only ts, user_id needed
    plan = physical(spark, "orders_audit")
    assert "o_orderpriority" not in plan


def test_text_scan_is_a_single_stage(spark):
    plan = physical(spark, "documents_privacy")
    assert exchanges(plan) == []
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
