"""Stored sums and sets: incremental loads, merged distinct counts, rejected dates."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from stagelight.operators.distinct import LOG_K, bitmaps, merged_count, merged_estimate, sketches
from stagelight.plans import analyses as A
from stagelight.plans.factorised import FactorisedBase
from stagelight.plans.monthly_store import DailySums, next_month, spans
from stagelight.plans.periods import MonthlyIds
from stagelight.session import new_shared_folder
from stagelight.sources.quarantine import date_quality, quarantine, quarantined_roles
from stagelight.sources.roles import Roles

from .conftest import money, ts
from .test_factorised import role_frames


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def with_transactions(roles: Roles, df) -> Roles:
    return Roles.from_frames({**roles.as_dict(), "transaction_data": df})


def dated(roles):
    return rows(FactorisedBase(roles).daily().where("Order_Date IS NOT NULL"))


# ------------------------------------------------------------- incremental sums
def test_months_in_runs():
    assert next_month("2023-12") == "2024-01"
    assert spans(["2024-01", "2023-12", "2024-03", "2024-03"]) == [("2023-12", "2024-02"), ("2024-03", "2024-04")]
    assert spans([]) == []


@pytest.mark.parametrize("seed", range(3))
def test_loads_equal_a_full_run(spark, seed):
    """Append, the same load again, and rows that come late for an old month."""
    roles = role_frames(spark, seed)
    td = roles.transaction_data
    store = DailySums(spark, new_shared_folder(spark, "test"))
    first = td.where("Order_Date < '2024-02-01'")
    assert store.load(with_transactions(roles, first), first) == ["2024-01"]
    assert rows(store.daily().drop("_month")) == dated(with_transactions(roles, first))
    second = td.where("Order_Date < '2024-04-01' AND Transaction_ID % 2 = 0")
    held = with_transactions(roles, first.unionByName(second.where("Order_Date >= '2024-02-01'")))
    for _ in range(2):
        store.load(held, second)
        assert rows(store.daily().drop("_month")) == dated(held)
    store.load(roles, td)  # the odd rows of old months come late
    assert rows(store.daily().drop("_month")) == dated(roles)
    assert rows(A.load_monthly_revenue(store.daily())) == rows(A.load_monthly_revenue(FactorisedBase(roles)))


def test_only_touched_months_are_written(spark):
    roles = role_frames(spark, 5)
    path = new_shared_folder(spark, "test")
    store = DailySums(spark, path)
    store.load(roles, roles.transaction_data)
    folder = path.removeprefix("file:")
    stamp = {m: sorted(os.listdir(f"{folder}/{m}")) for m in os.listdir(folder) if m.startswith("_month=")}
    assert store.load(roles, roles.transaction_data.where("Order_Date BETWEEN '2024-03-01' AND '2024-03-31'")) == ["2024-03"]
    changed = {m for m in stamp if sorted(os.listdir(f"{folder}/{m}")) != stamp[m]}
    assert changed == {"_month=2024-03"}


def test_a_month_that_lost_its_rows_is_emptied(spark):
    roles = role_frames(spark, 6)
    store = DailySums(spark, new_shared_folder(spark, "test"))
    store.load(roles, roles.transaction_data)
    left = with_transactions(roles, roles.transaction_data.where("Order_Date < '2024-02-01' OR Order_Date >= '2024-03-01'"))
    store.refresh(left, ["2024-02"])
    assert rows(store.daily().drop("_month")) == dated(left)
    store.refresh(left, [])


# ---------------------------------------------------------------- distinct sets
def seen(rng, n):
    ids = [0, 1, 32767, 32768, 40000, 10 ** 12, -5, None, *range(50, 70)]
    return [(rng.choice([None, *(dt.datetime(y, m, 3) for y in (2023, 2024) for m in (1, 2, 3, 6, 12))]), rng.choice(ids))
            for _ in range(n)]


def test_any_range_of_months_is_exact(spark):
    data = seen(random.Random(1), 400)
    store = MonthlyIds.build(spark.createDataFrame(data, "t timestamp_ntz, id bigint"), "t", "id")
    for first, last in (("2023-01", "2023-01"), ("2023-01", "2024-02"), ("2024-04", "2024-05"), ("0001-01", "9999-12")):
        want = {i for t, i in data if t and i is not None and first <= t.strftime("%Y-%m") <= last}
        assert store.between(first, last).collect()[0][0] == len(want)
    months = sorted({t.strftime("%Y-%m") for t, i in data if t and i is not None})
    number = lambda m: 12 * int(m[:4]) + int(m[5:])
    pick = lambda test: len({i for t, i in data if t and i is not None and test(t.strftime("%Y-%m"))})
    assert rows(store.by_period("n")) == [
        (m, pick(lambda x: x == m), pick(lambda x: 0 <= number(m) - number(x) < 3), pick(lambda x: x[:4] == m[:4] and x <= m))
        for m in months]
    assert all(r["estimate_is_near"] for r in store.estimated("n").collect())


def test_estimates_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("k"), (F.col("id") * 31).alias("x"))
    held = sketches(df, ["k"], "x")
    n = merged_estimate(held, [], "n").collect()[0][0]
    assert abs(n - 40_000) < 4 * 40_000 * 1.04 / 2 ** (LOG_K / 2)
    assert merged_count(bitmaps(df, ["k"], "x"), [], "n").collect()[0][0] == 40_000


def test_sets_of_nothing(spark):
    empty = spark.createDataFrame([], "t timestamp_ntz, id bigint")
    assert rows(merged_count(bitmaps(empty, ["t"], "id"), ["t"], "n")) == []
    assert rows(merged_estimate(sketches(empty, ["t"], "id"), ["t"], "n")) == []


# -------------------------------------------------------------------- quarantine
def test_bad_dates_are_kept_apart(spark):
    raw = spark.createDataFrame([(1, 1, "2024-01-05", 1.0), (2, 1, "05/01/2024", 2.0), (3, None, None, 3.0), (4, 2, "", 4.0),
                                 (5, 2, "2024-01-05 10:11:12", None), (6, 2, "2024-13-01", 1.0)],
                                "Transaction_ID bigint, Student_id bigint, Order_Date string, Transaction_Value double")
    good, rejects = quarantine(raw, "transaction_data")
    assert rows(good) == [(1, 1, ts("2024-01-05"), money(1)), (3, None, None, money(3)), (5, 2, ts("2024-01-05T10:11:12"), None)]
    assert rows(rejects) == sorted([("transaction_data", "Order_Date", t) for t in ("05/01/2024", "", "2024-13-01")], key=repr)
    assert rows(date_quality({"transaction_data": raw})) == [("transaction_data", "Order_Date", 6, 3, 3, 3)]
    with pytest.raises(Exception, match="(?i)cast"):  # strict loading is as it was
        Roles.from_frames({**role_frames(spark, 1).as_dict(), "transaction_data": raw}).transaction_data.collect()


def test_roles_of_the_good_rows(spark):
    frames = role_frames(spark, 2).as_dict()
    frames["course_history"] = spark.createDataFrame([(1, 2, "soon"), (1, 3, "2024-02-02")], "Teacher_id bigint, Course_id bigint, Course_Date string")
    roles, rejects = quarantined_roles(frames)
    assert rows(roles.course_history) == [(1, 3, ts("2024-02-02"))]
    assert rows(rejects) == [("course_history", "Course_Date", "soon")]
    assert roles.transaction_data.count() == frames["transaction_data"].count()
