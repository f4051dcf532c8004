"""The teacher frame from tables bucketed by course."""

from __future__ import annotations

import random

import pytest

from stagelight.operators.joins import SHARES
from stagelight.plans import frames
from stagelight.plans.bucketed import KEYS, BucketedClasses
from stagelight.sources.roles import Roles
from stagelight.sources.schemas import ROLE_SCHEMAS

from .conftest import SF001, ts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def roles_with_hot_courses(spark) -> Roles:
    """Course 1 holds a third of the classes, course 2 of the enrolments; classes
    without a course, courses without seats."""
    rng = random.Random(4)
    data = {
        "course_history": [(rng.choice([1, 2, None]), rng.choice([1] * 6 + [None] * 3 + list(range(2, 15))), ts("2024-01-02")) for _ in range(120)],
        "course_student": [(rng.choice([2] * 6 + list(range(1, 12))), rng.randrange(9), rng.choice([1, 2, 9])) for _ in range(60)] + [(None, 1, 1)],
        "course_basic": [(1,), (2,), (2,)],
        "teacher_basic": [(1, "A", "B"), (2, "C", None)],
        "student_basic": [(k, 20 + k, "Male") for k in range(6)],
        "student_learning_area": [(k % 7, f"c{k}", "r") for k in range(10)],
    }
    return Roles.from_frames({k: spark.createDataFrame(data.get(k, []), schema) for k, schema in ROLE_SCHEMAS.items()})


@pytest.mark.parametrize("shares", ["2", "4", "1000"])
def test_equals_the_frame(spark, shares):
    roles = roles_with_hot_courses(spark)
    spark.conf.set(SHARES, shares)
    try:
        store = BucketedClasses.write(roles, 4)
        got = rows(store.frame())
        if shares == "1000":  # every course is hot
            assert store.cold().count() == 0
    finally:
        spark.conf.unset(SHARES)
    assert got == rows(frames.teacher_performance(roles))
    store.release()
    assert not any(spark.catalog.tableExists(store.table(name)) for name in KEYS)


def test_the_bucketed_join_shuffles_nothing(spark):
    store = BucketedClasses.write(Roles.from_tpch(spark, SF001))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frames.taught_seats(store.cold())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Bucketed: true") == 2 and "Exchange" not in plan
    store.release()
