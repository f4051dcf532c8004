"""Properties of the analyses and the reference values of FIXTURES.md section 5
(sf0.01)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stagelight.plans import analyses as A
from stagelight.plans import catalog as C

from .conftest import SF001, SF01


@pytest.fixture(scope="module")
def ws(spark):
    return C.Workspace.from_tpch(spark, SF01)


def test_kpis(ws):
    k = A.kpi_summary(ws.base, ws.tp).collect()[0]
    assert k["total_revenue"] == pytest.approx(9_166_704_874.15, abs=0.005)
    assert (k["total_students"], k["total_teachers"]) == (1500, 90)
    assert k["avg_transaction"] == pytest.approx(250_394.84482367724, rel=1e-12)


def test_monthly_revenue_first_month(ws):
    out = A.monthly_revenue_growth(ws.base, C.BASE_FILTERS).collect()
    assert len(out) == 36
    assert out[0]["Month"] == "1996-01" and out[0]["Growth_Rate"] is None
    assert out[0]["Amount"] == pytest.approx(52_744_561.31, abs=0.005)


def test_heatmap_is_dense_and_sums_to_filtered_amount(ws):
    grid = A.booking_heatmap(ws.base, C.BASE_FILTERS)
    months = A.monthly_revenue_growth(ws.base, C.BASE_FILTERS).count()
    assert grid.count() == 7 * months == 252
    total = A.filtered_base(ws.base, C.BASE_FILTERS).agg(F.sum("Amount").cast("double")).collect()[0][0]
    assert grid.agg(F.sum("Amount")).collect()[0][0] == pytest.approx(total, rel=1e-12)


@pytest.mark.parametrize("f", [C.BASE_FILTERS, C.COMBINED_FILTERS, C.EMPTY_FILTERS, None])
def test_wide_heatmap_matches_long_form(ws, f):
    """Every month of the selection is a column, whatever the filter."""
    long = {(r["Day_of_Week"], r["Month"]): r["Amount"] for r in A.booking_heatmap(ws.base, f).collect()}
    wide = A.booking_heatmap_wide(ws.base, f)
    rows = wide.collect()
    assert len(rows) == 7
    assert wide.columns[2:] == sorted({m for _, m in long})
    got = {(r["Day_of_Week"], m): r[m] for r in rows for m in wide.columns[2:]}
    assert got.keys() == long.keys()
    assert all(got[k] == pytest.approx(long[k], rel=1e-12) for k in long)


def test_base_gender_counts(ws):
    got = {r[0]: r[1] for r in A.gender_distribution(ws.base).collect()}
    assert got == {"Male": 14_687, "Female": 14_252}
    assert A.filtered_base(ws.base, C.GENDER_FILTERS).count() == 22_357


def test_demographics_gender(ws):
    active = A.demo_selection(ws.base, ws.demo, C.ACTIVE_FILTERS)
    assert {r[0]: r[1] for r in A.demo_gender(active).collect()} == \
        {"Male": 1733, "Female": 1539, "Unknown": 853}
    sel = A.demo_selection(ws.base, ws.demo, C.DEMO_FILTERS)
    out = A.demo_gender(sel).collect()
    assert {r[0]: r[1] for r in out} == {"Male": 801, "Female": 683, "Unknown": 444}
    assert sum(r["share"] for r in out) == pytest.approx(1.0)


def test_histogram_bins(spark, ws):
    assert A.age_histogram(ws.base).count() == 11
    small = C.Workspace.from_tpch(spark, SF001)
    h = A.age_histogram(small.base).collect()
    assert len(h) == 20 and all(r["bin_end"] - r["bin_start"] == 5 for r in h)


def test_top_teachers_and_audience(ws):
    top = A.teacher_top5(ws.tp, C.TEACHER_FILTERS).collect()
    assert [(r[0][-9:], r[1]) for r in top] == [
        ("000000026", 291), ("000000021", 278), ("000000001", 277), ("000000030", 277),
        ("000000042", 277)]
    totals = A.audience_totals(ws.tp, C.TEACHER_FILTERS).collect()
    assert [(r[0][-9:], r[1]) for r in totals] == [
        ("000000042", 210), ("000000001", 202), ("000000026", 202), ("000000021", 201),
        ("000000030", 200)]
    grid = A.audience_unique_students(ws.tp, C.TEACHER_FILTERS).collect()
    assert len(grid) == 25
    per_teacher = {}
    for r in grid:
        per_teacher[r[0]] = per_teacher.get(r[0], 0) + r[2]
    for r in totals:
        assert per_teacher[r[0]] <= r[1]


def test_sales_totals_equal_class_counts(ws):
    ranked = A.teacher_sales_ranked(ws.tp, C.TEACHER_FILTERS).collect()
    top = {r[0]: r[1] for r in A.teacher_top5(ws.tp, C.TEACHER_FILTERS).collect()}
    for r in ranked:
        assert r["Total_Sales"] == top[r["Teacher_Name"]]
    assert sorted({r["rank"] for r in ranked}) == [1, 2, 3, 4, 5]


def test_small_scale_keeps_all_teachers(spark):
    small = C.Workspace.from_tpch(spark, SF001)
    assert A.teacher_top5(small.tp, C.TEACHER_FILTERS).count() == 8
    assert A.audience_top5(small.tp, C.TEACHER_FILTERS).count() == 5


def test_frame_column_order(ws):  # P4
    from stagelight.plans import frames
    assert ws.base.columns == frames.BASE_COLUMNS
    assert ws.demo.columns == frames.DEMOGRAPHICS_COLUMNS
    assert ws.tp.columns == frames.TEACHER_COLUMNS
