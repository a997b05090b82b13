"""Plans: how often a table is dealt, and what reaches the scan."""

from __future__ import annotations

import pytest

from netloom.plans.core import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,most", [("retransmit_mark", 1), ("packet_loss", 1), ("findings", 1), ("finding_markers", 2), ("txn_fifo", 1), ("zero_window_spans", 1)])
def test_tables_are_dealt_once(spark, name, most):
    assert plan(spark, name).count("Exchange ") <= most


@pytest.mark.parametrize("name", ["packets_in_time", "keyset_page", "drill_down"])
def test_time_bounds_reach_the_scan(spark, name):
    pushed = plan(spark, name).split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(ts," in pushed


def test_series_compute_only_what_was_asked_for(spark):
    assert "decimal" not in plan(spark, "top_n_segments").lower() and "late" not in plan(spark, "io_series_100ms")
