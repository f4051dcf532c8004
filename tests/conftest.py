from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from stagelight.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="stagelight-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


BASE_SCHEMA = ("Transaction_ID bigint, Student_id bigint, Order_Date timestamp_ntz, "
               "Customer_Age int, Customer_Gender string, City string, Region string, "
               "Course_Type_Name string, Amount decimal(18,2)")
DEMO_SCHEMA = ("StudentID bigint, Age int, Gender string, City string, Learning_Area string, "
               "Course_Type_id int, Course_Type_Name string, Course_Type_Note string")
TP_SCHEMA = ("Teacher_ID bigint, Teacher_Name string, Student_ID bigint, Student_Gender string, "
             "Student_Age int, Learning_City string, Learning_Area string, Course_Date timestamp_ntz")


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def money(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def base_rows(spark, rows):
    """rows: dicts with any subset of base columns."""
    cols = [c.split()[0] for c in BASE_SCHEMA.split(", ")]
    data = []
    for i, r in enumerate(rows):
        r = dict(r)
        r.setdefault("Transaction_ID", i + 1)
        r.setdefault("Student_id", i + 1)
        if isinstance(r.get("Order_Date"), str):
            r["Order_Date"] = ts(r["Order_Date"])
        r["Amount"] = money(r.get("Amount"))
        data.append(tuple(r.get(c) for c in cols))
    return spark.createDataFrame(data, BASE_SCHEMA)


def tp_rows(spark, rows):
    cols = [c.split()[0] for c in TP_SCHEMA.split(", ")]
    data = []
    for i, r in enumerate(rows):
        r = dict(r)
        r.setdefault("Student_ID", i + 1)
        r.setdefault("Student_Gender", "Unknown")
        r.setdefault("Learning_Area", "Unknown")
        if isinstance(r.get("Course_Date"), str):
            r["Course_Date"] = ts(r["Course_Date"])
        data.append(tuple(r.get(c) for c in cols))
    return spark.createDataFrame(data, TP_SCHEMA)
