"""Hand-made edge frames for the null and edge rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagelight.functions import age_group, percent_label
from stagelight.operators.filters import BASE_COLUMNS, Filters, apply_filters, member_of
from stagelight.plans import analyses as A
from stagelight.plans import frames
from stagelight.sources.roles import Roles

from .conftest import base_rows, tp_rows, ts


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_null_group_keys_dropped(spark):  # N1, N12
    b = base_rows(spark, [{"Customer_Gender": "Male"}, {"Customer_Gender": None},
                          {"Customer_Gender": "Female"}, {"Customer_Gender": "Male"}])
    assert rows(A.gender_distribution(b), "Customer_Gender", "n") == [("Male", 2), ("Female", 1)]


def test_all_null_month_sums_to_zero_and_mean_of_nothing(spark):  # N2, N3
    b = base_rows(spark, [{"Order_Date": "2024-01-05", "Amount": None},
                          {"Order_Date": "2024-02-05", "Amount": 10}])
    assert rows(A.revenue_trend(b), "Month", "Amount") == [("2024-01", 0.0), ("2024-02", 10.0)]
    empty = base_rows(spark, [{"Order_Date": "2024-01-05", "Amount": None}])
    tp = tp_rows(spark, [{"Teacher_ID": 1, "Teacher_Name": "a b"}])
    kpi = A.kpi_summary(empty, tp).collect()[0]
    assert kpi["avg_transaction"] is None and kpi["total_revenue"] == 0


def test_growth_sequence(spark):  # N4
    amounts = [100, 0, 0, 50, 75]
    b = base_rows(spark, [{"Order_Date": f"2024-0{i + 1}-01", "Amount": a}
                          for i, a in enumerate(amounts)])
    got = [r[1] for r in rows(A.monthly_revenue_growth(b), "Month", "Growth_Rate")]
    assert got == [None, -100.0, None, None, 50.0]


def test_growth_uses_previous_present_month(spark):  # W1 gap month
    b = base_rows(spark, [{"Order_Date": "2024-01-10", "Amount": 100},
                          {"Order_Date": "2024-03-10", "Amount": 150}])
    assert rows(A.monthly_revenue_growth(b), "Month", "Growth_Rate") == [("2024-01", None), ("2024-03", 50.0)]


def test_membership_with_null_pick(spark):  # N5
    b = base_rows(spark, [{"City": "x"}, {"City": None}, {"City": "y"}])
    got = b.where(member_of("City", ["x", None])).select("City").collect()
    assert sorted(r[0] or "" for r in got) == ["", "x"]
    assert b.where(member_of("City", [None])).count() == 1


def test_missing_weekdays_are_zero_filled(spark):  # N6
    b = base_rows(spark, [{"Order_Date": "2024-01-01", "Amount": 5},   # Monday
                          {"Order_Date": "2024-01-03", "Amount": 7}])  # Wednesday
    out = A.booking_heatmap(b)
    got = rows(out, "Day_of_Week", "day_no", "Month", "Amount")
    assert len(got) == 7
    assert got[0] == ("Monday", 1, "2024-01", 5.0) and got[2] == ("Wednesday", 3, "2024-01", 7.0)
    assert sum(r[3] for r in got) == 12.0


def test_age_group_edges(spark):  # N7, N8
    ages = [0, 1, 20, 21, 30, 50, 51, 100, 101, None]
    df = spark.createDataFrame([(a,) for a in ages], "a int")
    got = [r[0] for r in df.select(age_group(F.col("a"))).collect()]
    assert got == [None, "0-20", "0-20", "21-30", "21-30", "41-50", "50+", "50+", None, None]


def _teachers(spark, counts):
    data = []
    for name, n in counts.items():
        data += [{"Teacher_ID": 1, "Teacher_Name": name, "Course_Date": "2024-01-01"}] * n
    return tp_rows(spark, data)


def test_conditional_top5_keeps_all_up_to_ten(spark):  # T3
    tp = _teachers(spark, {f"t{i:02d}": i + 1 for i in range(10)})
    assert A.teacher_top5(tp).count() == 10


def test_conditional_top5_cuts_at_eleven_with_name_tiebreak(spark):  # T3, N9
    counts = {f"t{i:02d}": 1 for i in range(7)}
    counts.update({"a": 9, "b": 8, "c": 7, "e": 5, "d": 5})
    tp = _teachers(spark, counts)
    got = rows(A.teacher_top5(tp), "Teacher_Name", "n", "rank")
    assert got == [("a", 9, 1), ("b", 8, 2), ("c", 7, 3), ("d", 5, 4), ("e", 5, 5)]


def test_unknown_teachers_removed(spark):  # F6
    tp = tp_rows(spark, [{"Teacher_Name": "Unknown"}, {"Teacher_Name": None}, {"Teacher_Name": "a b"}])
    assert rows(A.teacher_selection(tp), "Teacher_Name") == [("a b",)]


def test_fan_out_counts_revenue_per_course_row(spark):  # N10
    roles = Roles.from_frames({
        "transaction_data": spark.createDataFrame(
            [(1, 7, ts("2024-01-01"), 10)], "a bigint, b bigint, c timestamp_ntz, d int")
            .toDF("Transaction_ID", "Student_id", "Order_Date", "Transaction_Value"),
        "student_basic": spark.createDataFrame([(7, 30, "Male")], "StudentID bigint, Age int, Gender string"),
        "student_learning_area": spark.createDataFrame([], "StudentID bigint, City string, Learning_Area string"),
        "student_learning_type": spark.createDataFrame([], "StudentID bigint"),
        "course_data": spark.createDataFrame([(7, 1), (7, 2)], "Student_id bigint, Course_Type_id int"),
        "course_type": spark.createDataFrame([(1, "a"), (2, "b")], "Course_Type_ID int, Course_Type_Name string"),
        "course_student": spark.createDataFrame([], "Course_id bigint, Student_id bigint, Course_Type_id int"),
        "course_basic": spark.createDataFrame([], "Course_Type_id int"),
        "teacher_basic": spark.createDataFrame([], "TeacherID bigint, FirstName string, LastName string"),
        "course_history": spark.createDataFrame([], "Teacher_id bigint, Course_id bigint, Course_Date timestamp_ntz"),
    })
    b = frames.base(roles)
    assert b.count() == 2
    assert A.kpi_summary(b, frames.teacher_performance(roles)).collect()[0]["total_revenue"] == 20.0


def test_end_bound_is_an_instant(spark):  # N11
    b = base_rows(spark, [{"Order_Date": "2024-01-31 12:00:00"}, {"Order_Date": "2024-01-31 00:00:00"}])
    f = Filters(start="2024-01-01", end="2024-01-31")
    assert apply_filters(b, f, BASE_COLUMNS).count() == 1


def test_dates_need_both_bounds(spark):  # F1
    b = base_rows(spark, [{"Order_Date": "2024-01-31"}, {"Order_Date": None}])
    assert apply_filters(b, Filters(start="2024-02-01"), BASE_COLUMNS).count() == 2


def test_half_name_becomes_unknown(spark):  # P3
    roles = Roles.from_frames({
        "transaction_data": spark.createDataFrame([], "Transaction_ID bigint, Student_id bigint, Order_Date timestamp_ntz, Transaction_Value decimal(18,2)"),
        "student_basic": spark.createDataFrame([], "StudentID bigint, Age int, Gender string"),
        "student_learning_area": spark.createDataFrame([], "StudentID bigint, City string, Learning_Area string"),
        "student_learning_type": spark.createDataFrame([], "StudentID bigint"),
        "course_data": spark.createDataFrame([], "Student_id bigint, Course_Type_id int"),
        "course_type": spark.createDataFrame([], "Course_Type_ID int, Course_Type_Name string"),
        "course_student": spark.createDataFrame([], "Course_id bigint, Student_id bigint, Course_Type_id int"),
        "course_basic": spark.createDataFrame([], "Course_Type_id int"),
        "teacher_basic": spark.createDataFrame([(1, "Ann", None), (2, "Bo", "Li")], "TeacherID bigint, FirstName string, LastName string"),
        "course_history": spark.createDataFrame([(1, 1, ts("2024-01-01")), (2, 1, ts("2024-01-02")), (3, 1, None)],
                                                "Teacher_id bigint, Course_id bigint, Course_Date timestamp_ntz"),
    })
    got = sorted(rows(frames.teacher_performance(roles), "Teacher_ID", "Teacher_Name"), key=str)
    assert got == [(1, "Unknown"), (2, "Bo Li"), (None, "Unknown")]


def test_two_januaries_share_a_label(spark):  # N15
    tp = tp_rows(spark, [{"Teacher_ID": 1, "Teacher_Name": "a", "Course_Date": "1996-01-05"},
                         {"Teacher_ID": 1, "Teacher_Name": "a", "Course_Date": "1997-01-07"},
                         {"Teacher_ID": 1, "Teacher_Name": "a", "Course_Date": "1997-02-07"}])
    got = rows(A.teacher_month_labels(tp), "Teacher_Name", "Month_Label", "month_no", "Class_Count")
    assert got == [("a", "Jan", 1, 2), ("a", "Feb", 2, 1)]


def test_empty_selection_keeps_schema(spark):  # F10
    b = base_rows(spark, [{"Order_Date": "2024-01-01", "Customer_Age": 30}])
    out = A.monthly_revenue_growth(b, Filters(age=(90, 99)))
    assert out.count() == 0 and out.columns == ["Month", "Amount", "Growth_Rate"]


def test_histogram_width_rule(spark):  # R6
    b = base_rows(spark, [{"Customer_Age": a} for a in (5, 50, 105)] + [{"Customer_Age": None}])
    got = rows(A.age_histogram(b), "bin_start", "bin_end", "n")
    assert got == [(0, 10, 1), (50, 60, 1), (100, 110, 1)]
    b2 = base_rows(spark, [{"Customer_Age": a} for a in (3, 4, 4)])
    assert rows(A.age_histogram(b2), "bin_start", "bin_end", "n") == [(3, 4, 1), (4, 5, 2)]


@pytest.mark.parametrize("x,label", [(12.34, "12.3%"), (-4.0, "-4.0%"), (0.25, "0.3%"),
                                     (100.0, "100.0%"), (-0.06, "-0.1%"), (None, None)])
def test_percent_label(spark, x, label):  # P11, R5
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(percent_label(F.col("x"))).collect()[0][0] == label


def test_audience_dense_grid_keeps_teacher_without_bucket(spark):  # N7
    tp = tp_rows(spark, [{"Teacher_ID": 1, "Teacher_Name": "a", "Student_ID": 1, "Student_Age": 150,
                          "Course_Date": "2024-01-01"},
                         {"Teacher_ID": 2, "Teacher_Name": "b", "Student_ID": 2, "Student_Age": 25,
                          "Course_Date": "2024-01-01"},
                         {"Teacher_ID": 2, "Teacher_Name": "b", "Student_ID": 2, "Student_Age": 25,
                          "Course_Date": "2024-01-02"}])
    grid = rows(A.audience_unique_students(tp), "Teacher_Name", "Age_Group", "students")
    assert len(grid) == 10
    assert ("a", "0-20", 0) in grid and ("b", "21-30", 1) in grid
    assert rows(A.audience_totals(tp), "Teacher_Name", "students") == [("a", 1), ("b", 1)]


def test_first_course_per_teacher(spark):  # W2
    tp = tp_rows(spark, [{"Teacher_ID": 1, "Teacher_Name": "a", "Course_Date": "2024-03-01"},
                         {"Teacher_ID": 1, "Teacher_Name": "a", "Course_Date": "2024-01-01"},
                         {"Teacher_ID": None, "Teacher_Name": "Unknown", "Course_Date": "2023-01-01"}])
    got = sorted(rows(A.teacher_first_course(tp), "Teacher_ID", "First_Course"), key=str)
    assert got == [(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (None, None)]


def test_demographics_view_dispatch(spark):  # N14
    from .conftest import DEMO_SCHEMA
    sel = spark.createDataFrame([(1, 30, "Male", "c", "r", 1, "a", "n"), (2, 40, "Unknown", "c", "r", 2, "b", "n")],
                                DEMO_SCHEMA)
    assert A.demographics_view(sel).columns == ["Gender", "n", "share"]
    assert A.demographics_view(sel, "region").columns == ["Learning_Area", "n"]
    with pytest.raises(ValueError):
        A.demographics_view(sel, "city")


def test_course_names_come_from_two_dimensions(spark):  # N13
    roles = Roles.from_frames({
        "transaction_data": spark.createDataFrame([(1, 7, ts("2024-01-01"), 10)],
                                                  "a bigint, b bigint, c timestamp_ntz, d int")
            .toDF("Transaction_ID", "Student_id", "Order_Date", "Transaction_Value"),
        "student_basic": spark.createDataFrame([(7, 30, None)], "StudentID bigint, Age int, Gender string"),
        "student_learning_area": spark.createDataFrame([], "StudentID bigint, City string, Learning_Area string"),
        "student_learning_type": spark.createDataFrame([], "StudentID bigint"),
        "course_data": spark.createDataFrame([(7, 1)], "Student_id bigint, Course_Type_id int"),
        "course_type": spark.createDataFrame([(1, "table name")], "Course_Type_ID int, Course_Type_Name string"),
        "course_student": spark.createDataFrame([(99, 7, 1)], "Course_id bigint, Student_id bigint, Course_Type_id int"),
        "course_basic": spark.createDataFrame([], "Course_Type_id int"),
        "teacher_basic": spark.createDataFrame([], "TeacherID bigint, FirstName string, LastName string"),
        "course_history": spark.createDataFrame([], "Teacher_id bigint, Course_id bigint, Course_Date timestamp_ntz"),
    })
    assert rows(frames.base(roles), "Course_Type_Name", "Customer_Gender") == [("table name", None)]
    demo = rows(frames.demographics(roles), "Course_Type_Name", "Course_Type_Note", "Gender", "Learning_Area")
    assert demo == [("瑜珈", "Yoga Classes", "Unknown", "Unknown")]  # N12: filled in demographics
