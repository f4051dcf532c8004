"""Join operators equal the plain joins they replace."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stagelight.operators.joins import BUCKETS, SHARES, hot_fans, hot_keys, key_counts, look_up, skew_left_join
from stagelight.plans.frames import student_attributes


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(params=["2", "8", "200"])
def shares(spark, request):
    spark.conf.set(SHARES, request.param)
    yield int(request.param)
    spark.conf.unset(SHARES)


def test_skew_left_join_equals_left_join(spark, shares):
    left = spark.createDataFrame(
        [(1, "a"), (1, "a2"), (2, "b"), (3, "c"), (None, "n"), (4, "d")], "k bigint, lv string")
    right_rows = [(1, f"x{i}") for i in range(40)] + [(1, "dup")] * 5 + \
                 [(2, "y"), (2, "y"), (None, "rn"), (5, "z")] + [(4, f"w{i}") for i in range(6)]
    right = spark.createDataFrame(right_rows, "rk bigint, rv string")
    expect = left.join(right, left["k"] == right["rk"], "left").select("k", "lv", "rk", "rv")
    got = skew_left_join(left, right, "k", "rk").select("k", "lv", "rk", "rv")
    assert _sorted(got) == _sorted(expect)


def test_skew_left_join_all_identical_hot_rows(spark, shares):
    left = spark.createDataFrame([(7, "a")], "k bigint, lv string")
    right = spark.createDataFrame([(7, "same")] * 20, "rk bigint, rv string")
    assert skew_left_join(left, right, "k", "rk").count() == 20


def test_skew_left_join_of_an_empty_side(spark, shares):
    left = spark.createDataFrame([(1, "a"), (None, "n")], "k bigint, lv string")
    right = spark.createDataFrame([], "rk bigint, rv string")
    assert _sorted(skew_left_join(left, right, "k", "rk").select("k", "lv", "rv")) == [(1, "a", None), (None, "n", None)]
    assert skew_left_join(right, left, "rk", "k").count() == 0


@pytest.mark.parametrize("salt", [None, ["lv"]])
def test_both_sides_salted_equals_left_join(spark, shares, salt):
    """Keys hot on the left, on the right, on both, and rows without a key."""
    left = spark.createDataFrame([(1, f"a{i}") for i in range(30)] + [(2, "b"), (3, "c"), (3, "c"), (None, "n")]
                                 + [(4, f"d{i}") for i in range(20)] + [(None, f"n{i}") for i in range(30)], "k bigint, lv string")
    right = spark.createDataFrame([(1, "x"), (1, "x2"), (2, "y")] + [(4, f"w{i}") for i in range(25)] + [(5, "z"), (None, "r")] * 9,
                                  "rk bigint, rv string")
    expect = left.join(right, left["k"] == right["rk"], "left").select("k", "lv", "rk", "rv")
    got = skew_left_join(left, right, "k", "rk", hot_fans(shares, right=(right, "rk"), left=(left, "k")), left_fan="left", left_salt=salt)
    assert got.columns == ["k", "lv", "rk", "rv"]
    assert _sorted(got) == _sorted(expect)


def test_left_rows_without_a_key_are_spread(spark, shares):
    left = spark.createDataFrame([(None, i) for i in range(400)] + [(1, 0)], "k bigint, lv int")
    right = spark.createDataFrame([(1, "x")], "rk bigint, rv string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = skew_left_join(left, right, "k", "rk", hot_fans(shares, right=(right, "rk"), left=(left, "k")), left_fan="left", left_salt=["lv"])
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 200


def test_hot_keys_are_those_above_an_equal_share(spark):
    rows = spark.createDataFrame([(1,)] * 60 + [(2,)] * 30 + [(k,) for k in range(3, 13)] + [(None,)] * 50, "k bigint")
    counts = key_counts(rows, "k")
    assert _sorted(hot_keys(counts, 4)) == [(1, 3), (2, 2)]
    assert _sorted(hot_keys(counts, 2)) == [(1, 2)]
    for shares in (1, 3, 10, 50):
        assert hot_keys(counts, shares).count() < max(shares, 2)


def test_fans_of_several_inputs(spark):
    """Each input's keys are measured against its own rows."""
    one = spark.createDataFrame([(1,)] * 60 + [(2,)] * 30 + [(k,) for k in range(3, 13)] + [(None,)] * 50, "a bigint")
    two = spark.createDataFrame([(2,)] * 5 + [(3,)], "b bigint")
    assert _sorted(hot_fans(4, one=(one, "a"), two=(two, "b"))) == [(1, 3 * BUCKETS, None), (2, 2 * BUCKETS, 4 * BUCKETS)]
    assert hot_fans(4, one=(one.limit(0), "a"), two=(two.limit(0), "b")).count() == 0


def test_look_up_equals_left_join(spark, shares):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(None, i) for i in range(50)] + [(2, 1), (3, 2), (3, 3)],
                                 "k bigint, v int")
    per_key = rows.where("k IS NOT NULL AND k <> 2").groupBy("k").agg(F.max("v").alias("m"), F.count("*").alias("n"))
    expect = rows.join(per_key.select("k", "m"), "k", "left").select("k", "v", "m")
    assert _sorted(look_up(rows, per_key, "k", "n", ["v"])) == _sorted(expect)


def test_student_attributes_equal_a_left_join_chain(spark):
    driver = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "k bigint")
    a = spark.createDataFrame([(1, "a1"), (1, "a2"), (3, "a3"), (9, "a9")], "_student_key bigint, a string")
    b = spark.createDataFrame([(1, "b1"), (2, "b2"), (2, "b3"), (None, "bn")], "_student_key bigint, b string")
    chain = (driver.join(a, driver["k"] == a["_student_key"], "left").drop("_student_key")
                   .join(b, F.col("k") == b["_student_key"], "left").select("k", "a", "b"))
    both = student_attributes(a, b)
    via = driver.join(both, driver["k"] == both["_student_key"], "left").select("k", "a", "b")
    assert _sorted(via) == _sorted(chain)
