"""The analysis frames built from the role tables.

* ``base``                - one row per transaction x learning-area row x course-bridge row
* ``business_trends``     - base + weekday and month names
* ``demographics``        - one row per student x area x learning-type x course-student row
* ``teacher_performance`` - one row per class x course-student x course-basic x area x student row

Row fan-out is part of the definition (counts are of joined rows), so no
loader de-duplicates anything. No loader sorts: order is applied only to
small aggregated outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import full_name, month_name, weekday_name
from ..operators.joins import hot_fans, shares_of, skew_left_join
from ..sources.literals import course_type_dim
from ..sources.roles import Roles

BASE_COLUMNS = ["Transaction_ID", "Student_id", "Order_Date", "Customer_Age", "Customer_Gender",
                "City", "Region", "Course_Type_Name", "Amount"]
DEMOGRAPHICS_COLUMNS = ["StudentID", "Age", "Gender", "City", "Learning_Area", "Course_Type_id",
                        "Course_Type_Name", "Course_Type_Note"]
TEACHER_COLUMNS = ["Teacher_ID", "Teacher_Name", "Student_ID", "Student_Gender", "Student_Age",
                   "Learning_City", "Learning_Area", "Course_Date"]

_K = "_student_key"  # join key column used inside the joins below


def student_attributes(student: DataFrame, area: DataFrame) -> DataFrame:
    """Per student key the product of its student rows and its area rows, a side
    without a row giving nulls: what LEFT JOINs of both to one driving table add.

    A union of area LEFT JOIN student and the students without an area rather
    than a full outer join, which AQE cannot split: here the area side, which may
    be hot, is preserved.
    """
    return area.join(student, _K, "left").unionByName(
        student.join(area.select(_K), _K, "left_anti"), allowMissingColumns=True)


def base(r: Roles) -> DataFrame:
    """transactions LEFT JOIN student, learning area, course bridge (+ course type).

    Two shuffle joins: with the students' attributes, then with the course
    bridge. Both salt keys that are hot on the right and students that are hot
    among the transactions; transactions without a student are spread.
    """
    ct = r.course_type.select(F.col("Course_Type_ID").alias("_ct"), "Course_Type_Name")
    cd = r.course_data
    bridge = (cd.join(ct, cd["Course_Type_id"] == ct["_ct"], "left")
              .select(F.col("Student_id").alias("_bk"), "Course_Type_Name"))
    student = r.student_basic.select(F.col("StudentID").alias(_K),
                                     F.col("Age").alias("Customer_Age"),
                                     F.col("Gender").alias("Customer_Gender"))
    area = r.student_learning_area.select(F.col("StudentID").alias(_K), "City",
                                          F.col("Learning_Area").alias("Region"))
    td = r.transaction_data
    # both joins are on the student: one table of the students hot in any input
    fans = hot_fans(shares_of(td), transactions=(td, "Student_id"), area=(area, _K), bridge=(cd, "Student_id"))
    hot = dict(fans=fans, left_fan="transactions", left_salt=["Transaction_ID"])
    known = skew_left_join(td, student_attributes(student, area), "Student_id", _K, right_fan="area", **hot).drop(_K)
    return (skew_left_join(known, bridge, "Student_id", "_bk", right_fan="bridge", **hot)
              .select("Transaction_ID", "Student_id", "Order_Date", "Customer_Age",
                      "Customer_Gender", "City", "Region", "Course_Type_Name",
                      F.col("Transaction_Value").alias("Amount")))


def with_calendar_names(b: DataFrame) -> DataFrame:
    """``base`` plus the weekday and month names of each order."""
    return b.select(*[F.col(f"`{c}`") for c in b.columns],
                    weekday_name(F.col("Order_Date")).alias("Day_of_Week"),
                    month_name(F.col("Order_Date")).alias("Month"))


def business_trends(r: Roles) -> DataFrame:
    return with_calendar_names(base(r))


def demographics(r: Roles) -> DataFrame:
    """students LEFT JOIN area, learning type, course_student, then the inline
    course dimension; Gender and Learning_Area filled with 'Unknown'.

    Course_Type_id stays an integer (null when missing) instead of the
    reference's mixed 'Unknown' text.
    """
    spark = r.student_basic.sparkSession
    area = r.student_learning_area.select(F.col("StudentID").alias("_ak"), "City", "Learning_Area")
    ltype = r.student_learning_type.select(F.col("StudentID").alias("_tk"))
    # (Course_id rides along only to give the salt a distinct value per row.)
    enrol = r.course_student.select(F.col("Student_id").alias("_ek"), "Course_Type_id",
                                    F.col("Course_id").alias("_eid"))
    attrs = skew_left_join(r.student_basic, area, "StudentID", "_ak").join(
        ltype, F.col("StudentID") == F.col("_tk"), "left").drop("_ak", "_tk")
    joined = skew_left_join(attrs, enrol, "StudentID", "_ek", salt_cols=["_eid"]).drop("_ek", "_eid")
    return (joined.join(course_type_dim(spark), "Course_Type_id", "left")
                  .select("StudentID", "Age",
                          F.coalesce("Gender", F.lit("Unknown")).alias("Gender"),
                          "City",
                          F.coalesce("Learning_Area", F.lit("Unknown")).alias("Learning_Area"),
                          "Course_Type_id", "Course_Type_Name", "Course_Type_Note"))


def seats(r: Roles) -> DataFrame:
    """The student rows of each course: course_student x course_basic x area x
    student, keyed by _ck."""
    cs, cb = r.course_student, r.course_basic
    typed = cs.join(cb, cs["Course_Type_id"] == cb["Course_Type_id"], "left") \
              .select(cs["Course_id"], cs["Student_id"].alias("_cs_student"))
    area = r.student_learning_area.select(F.col("StudentID").alias(_K),
                                          F.col("City").alias("Learning_City"), "Learning_Area")
    student = r.student_basic.select(F.col("StudentID").alias(_K),
                                     F.col("StudentID").alias("Student_ID"),
                                     F.col("Gender").alias("Student_Gender"),
                                     F.col("Age").alias("Student_Age"))
    return (skew_left_join(typed, student_attributes(student, area), "_cs_student", _K,
                           hot_fans(shares_of(cs), area=(area, _K)), "area")
            .select(F.col("Course_id").alias("_ck"), "Student_ID", "Student_Gender",
                    "Student_Age", "Learning_City", "Learning_Area"))


def classes(r: Roles) -> DataFrame:
    """The class history with its teachers: Teacher_ID, _name, Course_id, Course_Date."""
    tb = r.teacher_basic.select(F.col("TeacherID").alias("Teacher_ID"),
                                full_name(F.col("FirstName"), F.col("LastName")).alias("_name"))
    # (Spark resolves names case-insensitively: Teacher_id vs Teacher_ID must not meet.)
    ch = r.course_history.select(F.col("Teacher_id").alias("_tid"), "Course_id", "Course_Date")
    return ch.join(tb, ch["_tid"] == tb["Teacher_ID"], "left") \
             .select("Teacher_ID", "_name", "Course_id", "Course_Date")


def taught_seats(joined: DataFrame) -> DataFrame:
    """Columns and fills of ``teacher_performance`` from classes joined with seats."""
    return joined.select(
        "Teacher_ID",
        F.coalesce("_name", F.lit("Unknown")).alias("Teacher_Name"),
        "Student_ID",
        F.coalesce("Student_Gender", F.lit("Unknown")).alias("Student_Gender"),
        "Student_Age", "Learning_City",
        F.coalesce("Learning_Area", F.lit("Unknown")).alias("Learning_Area"),
        "Course_Date")


def teacher_performance(r: Roles) -> DataFrame:
    """class history LEFT JOIN teacher, then LEFT JOIN the per-course student
    rows (course_student x course_basic x area x student).

    The class history (the largest table) is the preserved side of both of
    its joins, so AQE may split a hot teacher or a hot course on that side; a
    hot course among the enrolments is salted by ``skew_left_join``.
    """
    cs = r.course_student
    return taught_seats(skew_left_join(classes(r), seats(r), "Course_id", "_ck",
                                       hot_fans(shares_of(cs), enrolment=(cs, "Course_id")), "enrolment"))


def class_teachers(r: Roles) -> DataFrame:
    """Teacher_ID of the teachers with a class: the only input the
    distinct-teacher KPI needs from ``teacher_performance``. No join there
    drops a class row and Teacher_ID comes only from the teacher table, so
    its distinct non-null values are exactly these. One row per teacher row."""
    # distinct first: a hot teacher is combined map-side and shuffled once
    taught = r.course_history.select("Teacher_id").distinct()
    tb = r.teacher_basic.select(F.col("TeacherID").alias("Teacher_ID"))
    return taught.join(tb, taught["Teacher_id"] == tb["Teacher_ID"], "inner").select(tb["Teacher_ID"])
