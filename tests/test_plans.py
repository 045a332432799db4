"""Shapes that must hold at any scale: no cross joins, no single-partition windows, pruned scans."""

import re

import pytest

from lakewright.plans import QUERIES

# these end in a window over at most ten result rows
BOUNDED_WINDOW = {"hybrid_topk_cap3"}
EAGER = {n for n in QUERIES if n.startswith(("stream_", "snapshot"))}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_global_window(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    if name in BOUNDED_WINDOW:
        return
    for block in re.findall(r"Window \[[^\n]*\n[^\n]*\n[^\n]*", plan):
        assert "SinglePartition" not in block, name


def scans(df):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df))


def test_flagship_reads_two_columns(spark, data):
    assert set(scans(QUERIES["fc_regression"](spark, data))) == {"ts:timestamp_ntz,value:double"}


def test_filters_reach_the_scan(spark, data):
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan_of(QUERIES["plant_registry_join"](spark, data))
    assert "EqualTo(role,user)" in plan_of(QUERIES["query_terms"](spark, data))


def test_rank_limits_are_applied_per_task(spark, data):
    assert "WindowGroupLimit" in plan_of(QUERIES["last_n_messages"](spark, data))


def test_events_are_scanned_once(spark, data):
    df = QUERIES["fc_regression"](spark, data)
    df.collect()
    assert plan_of(df).split("Initial Plan")[0].count("FileScan") == 1


def test_the_flagship_has_no_join(spark, data):
    plan = plan_of(QUERIES["fc_baselines"](spark, data))
    assert "Join" not in plan
