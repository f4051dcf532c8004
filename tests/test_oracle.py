"""Every registered query equals its DuckDB oracle (row count, columns,
types and an order-insensitive value hash) on the driver's test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from stagelight.operators.joins import SHARES, hot_keys, key_counts
from stagelight.plans.catalog import QUERIES, workspace_for
from stagelight.plans.oracle import ORACLE_SQL
from tools.check_oracle import SPARK_TO_DUCK, TABLES, digest

from .conftest import SF001, SF01

KEYS = sorted(QUERIES)  # those of the library itself; tests/llm has its own


@pytest.fixture(scope="module")
def duck():
    cons = {}
    for sf in (SF001, SF01):
        con = duckdb.connect()
        for t in TABLES:
            p = f"{sf}/{t}.parquet"
            if os.path.exists(p):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
        cons[sf] = con
    yield cons


def compare(spark, duck, sf, key):
    df = E.queries()[key](spark, sf)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols = df.columns
    s_types = [f.dataType.simpleString() for f in df.schema.fields]
    rel = duck[sf].execute(E.oracle_sql()[key])
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    si = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    di = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    d_types = [r[1] for r in duck[sf].execute(f"DESCRIBE {E.oracle_sql()[key]}").fetchall()]
    assert [SPARK_TO_DUCK.get(s_types[i], s_types[i]) for i in si] == [d_types[i] for i in di]
    assert len(s_rows) == len(d_rows)
    assert digest(s_rows, si) == digest(d_rows, di)


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle_sf01(spark, duck, key):
    compare(spark, duck, SF01, key)


@pytest.mark.parametrize("key", ["teacher_top5", "audience_top5", "audience_heatmap",
                                 "age_histogram", "demo_age_histogram", "monthly_revenue_growth"])
def test_matches_oracle_small_branches(spark, duck, key):
    """sf0.001 has 8 named teachers: the keep-all top-5 branch and the audience cut."""
    compare(spark, duck, SF001, key)


@pytest.fixture
def all_hot(spark):
    """So many shares that keys of the test tables exceed one."""
    spark.conf.set(SHARES, "20000")
    yield
    spark.conf.unset(SHARES)


def test_keys_are_hot(spark, all_hot):
    """The next test is about salted keys: real keys of every counted side are."""
    roles = workspace_for(spark, SF01).roles
    for role, key in (("course_data", "Student_id"), ("course_student", "Student_id"),
                      ("student_learning_area", "StudentID"), ("course_student", "Course_id")):
        fans = hot_keys(key_counts(getattr(roles, role), key), 20000).agg({"_fan": "max"}).first()[0]
        assert fans > 1, (role, key)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle_with_hot_keys(spark, duck, all_hot, key):
    compare(spark, duck, SF01, key)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["Month", "Amount", "Growth_Rate"]
    assert len(rows) > 0
