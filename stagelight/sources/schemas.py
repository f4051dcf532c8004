"""Declared schemas of the ten source roles (nothing is inferred at load)."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


LONG, INT, STR = T.LongType(), T.IntegerType(), T.StringType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(18, 2)

ROLE_SCHEMAS: dict[str, T.StructType] = {
    "transaction_data": _schema(
        ("Transaction_ID", LONG), ("Student_id", LONG), ("Order_Date", TS),
        ("Transaction_Value", MONEY)),
    "student_basic": _schema(("StudentID", LONG), ("Age", INT), ("Gender", STR)),
    # The source column is called "Learning Area" (with a space); it is
    # renamed to Learning_Area on load.
    "student_learning_area": _schema(("StudentID", LONG), ("City", STR), ("Learning_Area", STR)),
    "student_learning_type": _schema(("StudentID", LONG)),
    "course_data": _schema(("Student_id", LONG), ("Course_Type_id", INT)),
    "course_type": _schema(("Course_Type_ID", INT), ("Course_Type_Name", STR)),
    "course_student": _schema(("Course_id", LONG), ("Student_id", LONG), ("Course_Type_id", INT)),
    "course_basic": _schema(("Course_Type_id", INT)),
    "teacher_basic": _schema(("TeacherID", LONG), ("FirstName", STR), ("LastName", STR)),
    "course_history": _schema(("Teacher_id", LONG), ("Course_id", LONG), ("Course_Date", TS)),
}

# Source column names that differ from the canonical ones above.
SOURCE_RENAMES = {"student_learning_area": {"Learning Area": "Learning_Area"}}

# Roles the demographics extract requires before it runs.
DEMOGRAPHICS_ROLES = ("student_basic", "student_learning_area",
                      "student_learning_type", "course_student")
