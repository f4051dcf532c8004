"""The shared optional filters and how they map onto each frame.

A filter that is None or empty applies nothing. Which frame column a filter
hits differs per frame and is kept as the dashboard defines it (e.g. teacher
analyses take the class date as the date, ignore the course filter; the
demographics frame has no gender filter).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    start: str | None = None            # inclusive instant, e.g. '1996-01-01'
    end: str | None = None              # inclusive instant; a date means its midnight
    age: tuple[int, int] | None = None  # inclusive [lo, hi]
    course_types: Sequence[str | None] | None = None
    cities: Sequence[str | None] | None = None
    genders: Sequence[str | None] | None = None

    @property
    def has_dates(self) -> bool:
        return bool(self.start) and bool(self.end)


@dataclass(frozen=True)
class FilterColumns:
    """Frame column each filter applies to; None = the filter does not apply."""
    date: str | None
    age: str | None
    course: str | None
    city: str | None
    gender: str | None


BASE_COLUMNS = FilterColumns("Order_Date", "Customer_Age", "Course_Type_Name", "City",
                             "Customer_Gender")
DEMOGRAPHICS_COLUMNS = FilterColumns(None, "Age", "Course_Type_Name", "City", None)
TEACHER_COLUMNS = FilterColumns("Course_Date", "Student_Age", None, "Learning_City",
                                "Student_Gender")


# Name of the month partition column of materialized frames ('yyyy-MM').
MONTH_PARTITION = "_month"


def instant(text: str) -> Column:
    """A bound as a timestamp_ntz literal (a bare date is its midnight)."""
    return F.lit(text).cast("timestamp_ntz")


def date_range(col: str, start: str, end: str) -> Column:
    """Inclusive at both ends; null dates fail."""
    return (F.col(col) >= instant(start)) & (F.col(col) <= instant(end))


def num_range(col: str, lo, hi) -> Column:
    """Inclusive at both ends; null values fail."""
    return (F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi))


def member_of(col: str, values: Sequence[str | None]) -> Column:
    """Set membership where a picked null matches null values."""
    present = [v for v in values if v is not None]
    cond = F.col(col).isin(present) if present else F.lit(False)
    if len(present) != len(values):
        cond = cond | F.col(col).isNull()
    return cond


def month_range(start: str, end: str) -> Column:
    """Partition predicate implied by a date range: the 'yyyy-MM' month of
    every instant in [start, end] lies in [month(start), month(end)], and the
    bounds fold to constants, so Spark prunes the other month partitions."""
    fmt = "yyyy-MM"
    return ((F.col(MONTH_PARTITION) >= F.date_format(instant(start), fmt))
            & (F.col(MONTH_PARTITION) <= F.date_format(instant(end), fmt)))


def predicates(filters: Filters, cols: FilterColumns, partitioned: bool = False) -> list[Column]:
    out: list[Column] = []
    if filters.has_dates and cols.date:
        out.append(date_range(cols.date, filters.start, filters.end))
        if partitioned:
            out.append(month_range(filters.start, filters.end))
    if filters.age and cols.age:
        out.append(num_range(cols.age, filters.age[0], filters.age[1]))
    for values, col in ((filters.course_types, cols.course), (filters.cities, cols.city),
                        (filters.genders, cols.gender)):
        if values and col:
            out.append(member_of(col, values))
    return out


def apply_filters(df: DataFrame, filters: Filters | None, cols: FilterColumns) -> DataFrame:
    """Conjunction of every given filter (one Filter node; Catalyst pushes the
    parts it can through the joins down to the parquet scans)."""
    preds = predicates(filters or Filters(), cols, partitioned=MONTH_PARTITION in df.columns)
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def known_teachers(df: DataFrame, name_col: str = "Teacher_Name") -> DataFrame:
    """Drop rows whose teacher is unknown: name null or 'Unknown'."""
    return df.where(F.col(name_col).isNotNull() & (F.col(name_col) != F.lit("Unknown")))
