"""Sums and counts from sums per student equal those over the joined rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from stagelight.operators.aggregates import frequency
from stagelight.operators.filters import BASE_COLUMNS, Filters, apply_filters
from stagelight.plans import analyses as A, frames
from stagelight.plans.catalog import QUERIES, Workspace
from stagelight.plans.factorised import FactorisedBase
from stagelight.sources.roles import Roles
from stagelight.sources.schemas import ROLE_SCHEMAS

from .conftest import SF001, SF01, money

CITIES, NAMES, GENDERS = ["c1", "c2", None], ["瑜珈", "律動", "舞蹈", None], ["Male", "Female", None]


def role_frames(spark, seed: int) -> Roles:
    """Small roles with repeated, missing and null keys on every side."""
    rng = random.Random(seed)
    key = lambda: rng.choice([None, *range(9)])
    day = lambda: rng.choice([None, dt.datetime(2024, rng.randint(1, 4), rng.randint(1, 28), rng.choice([0, 13]))])
    rows = {
        "transaction_data": [(k, key(), day(), rng.choice([None, money(rng.randint(-500, 9999) / 100)])) for k in range(60)],
        "student_basic": [(rng.randrange(9), rng.choice([None, rng.randint(1, 80)]), rng.choice(GENDERS)) for _ in range(9)],
        "student_learning_area": [(rng.randrange(9), rng.choice(CITIES), "r") for _ in range(12)],
        "course_data": [(rng.randrange(9), rng.choice([None, 1, 2, 3, 4])) for _ in range(15)],
        "course_type": [(1, NAMES[0]), (2, NAMES[1]), (2, NAMES[2]), (3, None)],
    }
    return Roles.from_frames({name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in ROLE_SCHEMAS.items()})


def some_filters(seed: int) -> Filters:
    rng = random.Random(seed)
    pick = lambda values: rng.choice([None, tuple(rng.sample(values, rng.randint(1, len(values))))])
    dates = rng.choice([{}, dict(start="2024-01-15", end="2024-03-10")])
    return Filters(**dates, age=rng.choice([None, (10, 50)]), course_types=pick(NAMES), cities=pick(CITIES), genders=pick(GENDERS))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(10))
def test_equal_the_joined_rows(spark, seed):
    roles, filters = role_frames(spark, seed), some_filters(seed) if seed else Filters()
    base = apply_filters(frames.base(roles), filters, BASE_COLUMNS).cache()
    sums = FactorisedBase(roles, filters)
    assert rows(A.monthly_revenue_growth(sums, filters)) == rows(A.monthly_revenue_growth(base))
    assert rows(A.booking_heatmap(sums, filters)) == rows(A.booking_heatmap(base))
    for column in ("Course_Type_Name", "Customer_Gender", "Customer_Age", "City", "Region"):
        assert rows(sums.counts(column)) == rows(frequency(base, column)), column
    teachers = spark.createDataFrame([(1,), (2,), (None,)], "Teacher_ID bigint")
    got, want = (rows(A.kpi_summary(x, teachers)) for x in (sums, base))
    assert got == want
    assert rows(sums.daily().select("n_rows").groupBy().sum()) == [(base.count() or None,)]


SUMS = ["kpi_summary", "kpi_cards", "revenue_trend", "load_monthly_revenue", "course_distribution", "gender_distribution",
        "age_histogram", "monthly_revenue_growth", "growth_label", "booking_heatmap"]


@pytest.mark.parametrize("key", SUMS)
def test_no_fan_out_join_in_the_plan(spark, key):
    """No salted join, and both sides of the join by student have one row for each key."""
    text = QUERIES[key](spark, SF01)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" not in text and "Generate" not in text
    lines = text.splitlines()
    strip = lambda line: line.lstrip(" :+-")
    depth = lambda line: len(line) - len(strip(line))

    def below(k):
        return [j for j in range(k + 1, len(lines)) if depth(lines[j]) == depth(lines[k]) + 3
                and all(depth(x) > depth(lines[k]) for x in lines[k + 1:j + 1])]

    def unique(k):
        while strip(lines[k]).startswith(("Project", "Filter")):
            k = below(k)[0]
        return strip(lines[k]).startswith("Aggregate") or (strip(lines[k]).startswith("Join") and all(map(unique, below(k))))

    joins = [k for k, line in enumerate(lines) if strip(line).startswith("Join") and "Student_id" in line]
    assert joins
    for k in joins:
        assert all(map(unique, below(k))), text


def test_materialized_frames_are_summed_directly(spark):
    ws = Workspace.from_tpch(spark, SF001)
    assert isinstance(ws.sums, FactorisedBase)
    ws.materialize()
    assert ws.sums is ws.base
    ws.release()
