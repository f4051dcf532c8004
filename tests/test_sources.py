"""Role loading: declared schemas, renames, catalog checks, empty checks."""

from __future__ import annotations

import tempfile

import pytest

from stagelight.sources import (DEMOGRAPHICS_ROLES, ROLE_SCHEMAS, EmptyRelationError,
                                MissingTablesError, Roles, missing_tables, require_rows,
                                require_tables)
from stagelight.sources.roles import conform


def test_missing_tables_lists_absent_roles(spark):
    for name in DEMOGRAPHICS_ROLES:
        spark.catalog.dropTempView(name)
    assert missing_tables(spark) == sorted(DEMOGRAPHICS_ROLES)
    spark.createDataFrame([(1,)], "StudentID bigint").createOrReplaceTempView("student_learning_type")
    assert "student_learning_type" not in missing_tables(spark)
    with pytest.raises(MissingTablesError):
        require_tables(spark)
    spark.catalog.dropTempView("student_learning_type")


def test_require_rows(spark):
    with pytest.raises(EmptyRelationError):
        require_rows(spark.createDataFrame([], "a int"), "demographics")
    df = spark.createDataFrame([(1,)], "a int")
    assert require_rows(df, "x") is df


def test_conform_renames_casts_and_orders(spark):
    src = spark.createDataFrame([("C", 5, "N")], "City string, StudentID int, `Learning Area` string")
    out = conform(src, "student_learning_area")
    assert out.columns == ["StudentID", "City", "Learning_Area"]
    assert out.schema == ROLE_SCHEMAS["student_learning_area"]
    with pytest.raises(MissingTablesError):
        conform(src.drop("City"), "student_learning_area")


def test_roles_from_parquet_and_catalog(spark):
    root = tempfile.mkdtemp(prefix="roles-", dir="/tmp")
    sample = Roles.from_tpch(spark, "/root/testdata/sf0.001")
    for name, df in sample.as_dict().items():
        if name == "student_learning_area":
            df = df.withColumnRenamed("Learning_Area", "Learning Area")
        df.write.parquet(f"{root}/{name}")
    roles = Roles.from_parquet(spark, root)
    assert roles.student_learning_area.columns == ["StudentID", "City", "Learning_Area"]
    assert roles.course_history.count() == sample.course_history.count()
    roles.register_views()
    again = Roles.from_catalog(spark)
    assert again.transaction_data.count() == sample.transaction_data.count()
    for name in ROLE_SCHEMAS:
        spark.catalog.dropTempView(name)


def test_text_dates_and_double_amounts_from_parquet(spark, tmp_path):  # X1
    (spark.createDataFrame([(1, 2, "2024-01-05 10:00:00", 12.5), (2, 2, "2024-02-01", None)],
                           "Transaction_ID int, Student_id long, Order_Date string, Transaction_Value double")
     .write.parquet(f"{tmp_path}/transaction_data"))
    got = Roles.from_parquet(spark, str(tmp_path)).transaction_data
    assert got.schema == ROLE_SCHEMAS["transaction_data"]
    assert [(r["Order_Date"].isoformat(), r["Transaction_Value"] and float(r["Transaction_Value"]))
            for r in got.orderBy("Transaction_ID").collect()] == [("2024-01-05T10:00:00", 12.5), ("2024-02-01T00:00:00", None)]


def test_text_dates_parse_strictly(spark):  # X1
    ok = spark.createDataFrame([(1, 2, "2024-01-05 10:00:00", "12.50")],
                               "Transaction_ID long, Student_id long, Order_Date string, Transaction_Value string")
    row = conform(ok, "transaction_data").collect()[0]
    assert row["Order_Date"].isoformat() == "2024-01-05T10:00:00"
    assert str(row["Transaction_Value"]) == "12.50"
    bad = spark.createDataFrame([(1, 2, "not a date", "1")],
                                "Transaction_ID long, Student_id long, Order_Date string, Transaction_Value string")
    with pytest.raises(Exception):
        conform(bad, "transaction_data").collect()


def test_workspace_validate(spark):
    from stagelight.plans.catalog import Workspace
    ws = Workspace.from_tpch(spark, "/root/testdata/sf0.001")
    assert ws.validate() is ws
