"""Frames extracted once (month-partitioned tables in the checkpoint folder)
give the same answers as the lazy plans, and date filters prune partitions."""

from __future__ import annotations

import contextlib
import io

import pytest

from stagelight.plans import catalog as C

from .conftest import SF001

KEYS = ["load_transactions", "load_business_trends", "load_teacher_performance", "kpi_summary", "monthly_revenue_growth",
        "booking_heatmap_wide", "filter_combined", "demo_gender", "teacher_sales_ranked",
        "audience_heatmap", "teacher_first_course", "filter_known_teachers"]


@pytest.fixture(scope="module")
def served(spark):
    return C.Workspace.from_tpch(spark, SF001).materialize(partition_by_month=True)


@pytest.mark.parametrize("key", KEYS)
def test_materialized_equals_lazy(spark, served, key):
    lazy = C.QUERIES[key](spark, SF001)
    mat = C.run_on(served, key)
    assert mat.columns == lazy.columns
    assert sorted(map(repr, mat.collect())) == sorted(map(repr, lazy.collect()))


def test_date_filter_prunes_month_partitions(served):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        C.run_on(served, "monthly_revenue_growth").explain(mode="formatted")
    text = buf.getvalue()
    assert any(line.startswith("PartitionFilters: [") and "_month" in line for line in text.splitlines())


def test_checkpointed_frames_equal_lazy(spark):
    ws = C.Workspace.from_tpch(spark, SF001).materialize(partition_by_month=False)
    for key in ("kpi_summary", "teacher_top5", "demo_gender"):
        lazy = C.QUERIES[key](spark, SF001)
        assert sorted(map(repr, C.run_on(ws, key).collect())) == sorted(map(repr, lazy.collect()))
