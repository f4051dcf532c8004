"""Plan shape: no Python in the hot path, no cross joins, filters reach the
scans, semi joins stay semi joins, no window over raw teacher rows, and no
global sort of row-level outputs."""

from __future__ import annotations

import contextlib
import io

import pytest

from stagelight.plans.catalog import QUERIES

from .conftest import SF01

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF")
CROSS_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(spark, key: str) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[key](spark, SF01).explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {key: plan(spark, key) for key in QUERIES}


def test_no_python_and_no_cross_join(plans):
    for key, text in plans.items():
        for node in PYTHON_NODES + CROSS_NODES:
            assert node not in text, f"{key} has {node}"


def test_filters_pushed_to_scans(plans):
    for key in ("filter_combined", "monthly_revenue_growth", "teacher_top5", "demo_gender"):
        pushed = [line for line in plans[key].splitlines() if line.startswith("PushedFilters: [")]
        assert any("o_orderdate" in p or "l_shipdate" in p for p in pushed), key


def test_semi_join_for_active_students(plans):
    assert "LeftSemi" in plans["active_students"]


def test_first_course_is_aggregate_not_window(plans):
    assert "Window" not in plans["teacher_first_course"]


def test_row_level_outputs_are_not_globally_sorted(plans):
    for key in ("load_transactions", "load_teacher_performance", "load_demographics", "load_teacher_performance_bucketed",
                "filter_combined", "active_students", "age_bucket"):
        assert "rangepartitioning" not in plans[key], key


def test_scans_read_only_needed_columns(plans):
    scans = [line for line in plans["monthly_revenue_growth"].splitlines()
             if line.startswith("ReadSchema:")]
    assert scans and all("o_orderpriority" not in s and "c_name" not in s for s in scans)


def test_histogram_plans_hold_their_input_twice(plans):
    """The width is one scalar subquery; its candidates must not repeat the input."""
    for key, other in (("age_histogram", "gender_distribution"), ("demo_age_histogram", "demo_gender")):
        assert len(scans(plans[key])) <= 2 * len(scans(plans[other])) + 2, key
        assert len(plans[key]) < 300_000, (key, len(plans[key]))


def test_wide_heatmap_reads_its_written_sums_alone(plans):
    """The pivot reads the small table; the orders were read once, to write it."""
    assert "weekday-months" in plans["booking_heatmap_wide"] and "orders.parquet" not in plans["booking_heatmap_wide"]


def test_no_full_outer_join(plans):
    """A full outer join could be split neither by AQE nor by salting under a hot key."""
    for key, text in plans.items():
        assert "FullOuter" not in text, key


def scans(text: str) -> list[str]:
    """Location of each file scan with its pushed filters."""
    lines = text.splitlines()
    return [a + " " + next(x for x in lines[i:] if x.startswith(("PushedFilters", "ReadSchema")))
            for i, a in enumerate(lines) if a.startswith("Location:")]


def test_facts_are_not_scanned_without_the_date_filter(plans):
    """Class history (lineitem) is read by its date range alone."""
    for key in ("teacher_top5", "teacher_sales_ranked"):
        facts = [s for s in scans(plans[key]) if "lineitem" in s]
        assert facts and all("l_shipdate" in s for s in facts), key


def test_facets_read_their_owning_tables(plans):
    for key in ("facet_age_bounds", "facet_age_marks"):
        assert len(scans(plans[key])) == 1 and "Join" not in plans[key], key
    for key in ("facet_cities", "facet_genders", "facet_course_types"):
        assert "LeftSemi" in plans[key] and "lineitem" not in plans[key], key


#: Those that write a small table first and read it again: the months that become
#: columns, and the stored sums and sets.
WRITE_FIRST = {"booking_heatmap_wide", "revenue_incremental", "students_by_period", "students_estimated", "teachers_by_period",
               "load_teacher_performance_bucketed"}


def test_no_job_runs_while_a_plan_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    for key in set(QUERIES) - WRITE_FIRST:
        spark.sparkContext.setJobGroup(f"plan-{key}", key)
        QUERIES[key](spark, SF01)
        assert not tracker.getJobIdsForGroup(f"plan-{key}"), key


@pytest.fixture(scope="module")
def cluster_plans(spark):
    """Plans as a large cluster gets them: no static broadcast by file size."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield {k: plan(spark, k) for k in QUERIES}
    finally:
        spark.conf.set(key, old)


def test_cluster_plans_keep_the_invariants(cluster_plans):
    for key, text in cluster_plans.items():
        for node in PYTHON_NODES + CROSS_NODES + ("FullOuter",):
            assert node not in text, f"{key} has {node}"
    assert "SortMergeJoin" in cluster_plans["load_transactions"] and "_lbucket" in cluster_plans["load_transactions"]
