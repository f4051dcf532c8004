"""Registered queries: every analysis bound to its default parameters and to
the role tables of one data folder.

``QUERIES[key](spark, sf_dir)`` returns a DataFrame; ``stagelight.plans.oracle``
holds the DuckDB SQL for the same key and parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import month_key
from ..operators.filters import MONTH_PARTITION, Filters
from ..session import configure, delete_folder, ensure_checkpoint_dir, new_shared_folder
from ..sources import quarantine
from ..sources.roles import Roles, require_rows
from . import analyses as A
from . import frames
from .bucketed import BucketedClasses
from .factorised import FactorisedBase
from .monthly_store import DailySums
from .periods import MonthlyIds

# Default parameters of the registered queries.
DATES = ("1996-01-01", "1998-12-31")
ACTIVE_DATES = ("2001-06-01", "2001-12-31")

BASE_FILTERS = Filters(start=DATES[0], end=DATES[1], age=(10, 60))
DEMO_FILTERS = Filters(start=ACTIVE_DATES[0], end=ACTIVE_DATES[1], age=(10, 60))
ACTIVE_FILTERS = Filters(start=ACTIVE_DATES[0], end=ACTIVE_DATES[1])
TEACHER_FILTERS = Filters(start=DATES[0], end=DATES[1], age=(10, 105))
# Nothing is left: no student of the test tables is that old.
EMPTY_FILTERS = Filters(start=DATES[0], end=DATES[1], age=(900, 901))
# Demographics without a date range: every student with a transaction.
UNDATED_FILTERS = Filters(age=(10, 60))

DATE_FILTERS = Filters(start=DATES[0], end=DATES[1])
AGE_FILTERS = Filters(age=(10, 60))
COURSE_FILTERS = Filters(course_types=("瑜珈", None))
CITY_FILTERS = Filters(cities=("NATION_1", "NATION_7", "NATION_13", None))
GENDER_FILTERS = Filters(genders=("Male", None))
COMBINED_FILTERS = replace(BASE_FILTERS, course_types=("瑜珈", "律動"),
                           cities=("NATION_2", "NATION_3", "NATION_5", "NATION_8", "NATION_21"),
                           genders=("Female", "Male"))
# Every filter given at once to the other two frames: on demographics the
# gender filter does not apply; on the teacher frame the course filter does not.
DEMO_COMBINED_FILTERS = replace(DEMO_FILTERS, course_types=("瑜珈", "舞蹈"),
                                cities=("NATION_4", "NATION_9", "NATION_16", None),
                                genders=("Female",))
TEACHER_COMBINED_FILTERS = replace(TEACHER_FILTERS, course_types=("律動",),
                                   cities=("NATION_0", "NATION_6", "NATION_11", "NATION_20"),
                                   genders=("Male", "Unknown"))


class Workspace:
    """Role tables and frames of one data folder (all lazy)."""

    def __init__(self, roles: Roles):
        self.roles = roles
        self._written: str | None = None  # folder of materialized tables
        self._extracted = False

    @cached_property
    def base(self) -> DataFrame:
        return frames.base(self.roles)

    @property
    def sums(self) -> DataFrame | FactorisedBase:
        """What sums and counts over base take: sums per student from the roles, or
        the frame itself where it has been extracted."""
        return self.base if self._extracted else FactorisedBase(self.roles)

    @cached_property
    def demo(self) -> DataFrame:
        return frames.demographics(self.roles)

    @cached_property
    def tp(self) -> DataFrame:
        return frames.teacher_performance(self.roles)

    @classmethod
    def from_tpch(cls, spark: SparkSession, sf_dir: str) -> "Workspace":
        configure(spark)
        return cls(Roles.from_tpch(spark, sf_dir))

    def validate(self) -> "Workspace":
        """The start-up checks: the demographics extract must hold rows."""
        require_rows(self.demo, "demographics")
        return self

    def materialize(self, partition_by_month: bool = True) -> "Workspace":
        """Extract the frames once, for a session that serves many analyses
        from them, cutting their lineage in the cluster's shared checkpoint
        folder (``spark.checkpoint.dir``; never a machine-local folder).

        With ``partition_by_month`` the two dated frames are written as
        parquet tables partitioned by month, so that every date-filtered
        analysis reads only the months in its range (the filters add the
        matching partition predicate); the demographics frame is checkpointed.
        """
        spark = self.roles.transaction_data.sparkSession
        root = ensure_checkpoint_dir(spark)
        if not root:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        self._extracted = True
        if not partition_by_month:
            self.base = self.base.checkpoint(eager=True)
            self.demo = self.demo.checkpoint(eager=True)
            self.tp = self.tp.checkpoint(eager=True)
            return self
        run_dir = f"{root.rstrip('/')}/stagelight-frames-{uuid.uuid4().hex}"
        self._written = run_dir
        self.base = write_by_month(self.base, "Order_Date", f"{run_dir}/base")
        self.tp = write_by_month(self.tp, "Course_Date", f"{run_dir}/teacher_performance")
        self.demo = self.demo.checkpoint(eager=True)
        return self

    def release(self) -> None:
        """Removes the tables that ``materialize`` wrote; its frames go with them."""
        if self._written:
            delete_folder(self.roles.transaction_data.sparkSession, self._written)
            self._written = None


def write_by_month(df: DataFrame, ts: str, path: str) -> DataFrame:
    """Write ``df`` partitioned by the 'yyyy-MM' month of ``ts`` and read it
    back with its schema (plus the partition column).

    The REBALANCE hint shuffles rows by month and lets AQE split heavy months
    and merge light ones into advisory-size tasks, so each month gets a few
    large files instead of one small file per input task.
    """
    df.withColumn(MONTH_PARTITION, month_key(F.col(ts))).hint("rebalance", MONTH_PARTITION) \
      .write.mode("errorifexists").partitionBy(MONTH_PARTITION).parquet(path)
    schema = T.StructType(df.schema.fields + [T.StructField(MONTH_PARTITION, T.StringType(), True)])
    return df.sparkSession.read.schema(schema).parquet(path)


def as_output(df: DataFrame) -> DataFrame:
    """Exact decimals inside, doubles at the boundary; internal columns
    (leading underscore, e.g. the month partition) never reach an output."""
    cols = [df[f"`{f.name}`"].cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else df[f"`{f.name}`"] for f in df.schema.fields if not f.name.startswith("_")]
    return df.select(*cols)


def workspace_for(spark: SparkSession, sf_dir: str) -> Workspace:
    """The lazy plans over a folder's files as they are now."""
    return Workspace.from_tpch(spark, sf_dir)


def _q(fn: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_output(fn(workspace_for(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    return run


def _demo(w: Workspace) -> DataFrame:
    return A.demo_selection(w.roles.transaction_data, w.demo, DEMO_FILTERS)


# The incremental query's first load ends before this day.
FIRST_LOAD_END = "2000-01-01"


def _loaded_in_steps(w: Workspace) -> DataFrame:
    """Monthly revenue and growth from daily sums that were loaded in two steps, the
    second of them twice; rows of the second load also fall in months of the first."""
    td = w.roles.transaction_data
    spark = td.sparkSession
    late = F.col("Order_Date").isNull() | (F.col("Order_Date") >= F.lit(FIRST_LOAD_END).cast("timestamp_ntz")) \
        | (F.dayofmonth("Order_Date") > 25)
    store = DailySums(spark, new_shared_folder(spark, "daily-sums"))
    first = Roles.from_frames({**w.roles.as_dict(), "transaction_data": td.where(~late)})
    store.load(first, first.transaction_data)
    for _ in range(2):
        store.load(w.roles, td.where(late))
    return A.load_monthly_revenue(store.daily())


def _class_teachers_dated(w: Workspace) -> DataFrame:
    """Class date and id of teachers that the teacher table knows."""
    tb = w.roles.teacher_basic.select(F.col("TeacherID").alias("Teacher_id"))
    return w.roles.course_history.select("Teacher_id", "Course_Date").join(tb, "Teacher_id", "left_semi")


def _text_dates(w: Workspace) -> dict[str, DataFrame]:
    """Stand-in tables with dates as text, some of which no calendar knows."""
    def texts(df: DataFrame, key: str, ts: str) -> DataFrame:
        k, day = F.col(key), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
        text = (F.when(k % 97 == 5, F.lit("unknown")).when(k % 97 == 11, F.date_format(ts, "dd/MM/yyyy"))
                .when(k % 97 == 17, F.lit("")).when(k % 89 == 3, F.lit(None)).otherwise(day))
        return df.withColumn(ts, text)
    return {"transaction_data": texts(w.roles.transaction_data, "Transaction_ID", "Order_Date"),
            "course_history": texts(w.roles.course_history, "Course_id", "Course_Date")}


def _ids(df: DataFrame, ts: str, id_col: str) -> MonthlyIds:
    return MonthlyIds.build(df, ts, id_col)


ANALYSES: dict[str, Callable[[Workspace], DataFrame]] = {
    # loaders
    "load_transactions": (lambda w: w.base),
    "load_business_trends": (lambda w: frames.with_calendar_names(w.base)),
    "load_monthly_revenue": (lambda w: A.load_monthly_revenue(w.sums)),
    "load_demographics": (lambda w: w.demo),
    "load_teacher_performance": (lambda w: w.tp),
    "load_teacher_performance_bucketed": (lambda w: BucketedClasses.write(w.roles).frame()),
    "teacher_first_course": (lambda w: A.teacher_first_course(w.tp)),
    # headline + facets
    "kpi_summary": (lambda w: A.kpi_summary(w.sums, frames.class_teachers(w.roles))),
    "kpi_cards": (lambda w: A.kpi_cards(w.sums, frames.class_teachers(w.roles))),
    "facet_date_bounds": (lambda w: A.facet_date_bounds(w.roles.transaction_data)),
    "facet_age_bounds": (lambda w: A.facet_age_bounds(w.roles.student_basic)),
    "facet_age_marks": (lambda w: A.facet_age_marks(w.roles.student_basic)),
    "facet_course_types": (lambda w: A.facet_course_types(w.roles.transaction_data, w.roles.course_data,
                                                          w.roles.course_type)),
    "facet_cities": (lambda w: A.facet_cities(w.roles.student_basic, w.roles.student_learning_area)),
    "facet_genders": (lambda w: A.facet_genders(w.roles.transaction_data, w.roles.student_basic)),
    # filters
    "filter_date_range": (lambda w: A.filtered_base(w.base, DATE_FILTERS)),
    "filter_age_range": (lambda w: A.filtered_base(w.base, AGE_FILTERS)),
    "filter_course_types": (lambda w: A.filtered_base(w.base, COURSE_FILTERS)),
    "filter_cities": (lambda w: A.filtered_base(w.base, CITY_FILTERS)),
    "filter_genders": (lambda w: A.filtered_base(w.base, GENDER_FILTERS)),
    "filter_combined": (lambda w: A.filtered_base(w.base, COMBINED_FILTERS)),
    "filter_empty": (lambda w: A.filtered_base(w.base, EMPTY_FILTERS)),
    "filter_demo_undated": (lambda w: A.demo_selection(w.roles.transaction_data, w.demo, UNDATED_FILTERS)),
    "filter_known_teachers": (lambda w: A.teacher_selection(w.tp)),
    "filter_demo_combined": (lambda w: A.demo_selection(w.roles.transaction_data, w.demo,
                                                        DEMO_COMBINED_FILTERS)),
    "filter_teacher_combined": (lambda w: A.teacher_selection(w.tp, TEACHER_COMBINED_FILTERS)),
    "teacher_top5_combined": (lambda w: A.teacher_top5(w.tp, TEACHER_COMBINED_FILTERS)),
    # overview charts
    "revenue_trend": (lambda w: A.revenue_trend(w.sums)),
    "course_distribution": (lambda w: A.course_distribution(w.sums)),
    "gender_distribution": (lambda w: A.gender_distribution(w.sums)),
    "age_histogram": (lambda w: A.age_histogram(w.sums)),
    # revenue & bookings
    "monthly_revenue_growth": (lambda w: A.monthly_revenue_growth(w.sums, BASE_FILTERS)),
    "growth_label": (lambda w: A.growth_label(w.sums, BASE_FILTERS)),
    "booking_heatmap": (lambda w: A.booking_heatmap(w.sums, BASE_FILTERS)),
    "booking_heatmap_wide": (lambda w: A.booking_heatmap_wide(w.sums, BASE_FILTERS)),
    "revenue_incremental": _loaded_in_steps,
    # distinct ids of periods, from stored sets per month
    "students_by_period": (lambda w: _ids(w.roles.transaction_data, "Order_Date", "Student_id").by_period("students")),
    "students_estimated": (lambda w: _ids(w.roles.transaction_data, "Order_Date", "Student_id").estimated("students")),
    "teachers_by_period": (lambda w: _ids(_class_teachers_dated(w), "Course_Date", "Teacher_id").by_period("teachers")),
    # loading
    "date_quality": (lambda w: quarantine.date_quality(_text_dates(w))),
    # demographics
    "active_students": (lambda w: A.active_students(w.roles.transaction_data, w.demo, ACTIVE_FILTERS)),
    "demo_gender": (lambda w: A.demo_gender(_demo(w))),
    "demo_age_histogram": (lambda w: A.demo_age_histogram(_demo(w))),
    "demo_course": (lambda w: A.demo_course(_demo(w))),
    "demo_region": (lambda w: A.demo_region(_demo(w))),
    "demo_region_cities": (lambda w: A.demo_region_cities(_demo(w))),
    "demo_age_course": (lambda w: A.demo_age_course(_demo(w))),
    "demo_age_course_wide": (lambda w: A.demo_age_course_wide(_demo(w))),
    # teachers
    "teacher_class_totals": (lambda w: A.teacher_class_totals(w.tp, TEACHER_FILTERS)),
    "teacher_top5": (lambda w: A.teacher_top5(w.tp, TEACHER_FILTERS)),
    "teacher_monthly_classes": (lambda w: A.teacher_monthly_classes(w.tp, TEACHER_FILTERS)),
    "teacher_sales_ranked": (lambda w: A.teacher_sales_ranked(w.tp, TEACHER_FILTERS)),
    "teacher_month_labels": (lambda w: A.teacher_month_labels(w.tp, TEACHER_FILTERS)),
    # audience
    "age_bucket": (lambda w: A.age_bucket(w.tp, TEACHER_FILTERS)),
    "audience_unique_students": (lambda w: A.audience_unique_students(w.tp, TEACHER_FILTERS)),
    "audience_totals": (lambda w: A.audience_totals(w.tp, TEACHER_FILTERS)),
    "audience_top5": (lambda w: A.audience_top5(w.tp, TEACHER_FILTERS)),
    "audience_heatmap": (lambda w: A.audience_heatmap(w.tp, TEACHER_FILTERS)),
}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    key: _q(fn) for key, fn in ANALYSES.items()}


def run_on(workspace: Workspace, key: str) -> DataFrame:
    """A registered analysis on an existing (e.g. materialized) workspace."""
    return as_output(ANALYSES[key](workspace))
