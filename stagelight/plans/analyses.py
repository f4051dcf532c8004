"""One function per analysis. Each takes frames (DataFrames) plus optional
``Filters`` and returns a DataFrame; nothing is collected to the driver.

Frames: ``base`` (transactions), ``demo`` (demographics), ``tp`` (teacher
performance); see ``stagelight.plans.frames``. Where ``base`` is only summed or
counted it may also be a ``FactorisedBase``, which gives the same rows from sums per
student instead of the joined rows (``stagelight.plans.factorised``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (age_group, count_text, money_text, month_key, month_key_to_date,
                         month_label, percent_label)
from ..operators.aggregates import (conditional_top_k, frequency, growth_rate,
                                    drop_null_group, histogram, histogram_of_counts, largest_first, money_sum, monthly_sum, ranked_head,
                                    weekday_month_grid, weekday_month_pivot, with_share)
from ..operators.filters import (BASE_COLUMNS, DEMOGRAPHICS_COLUMNS, TEACHER_COLUMNS, Filters,
                                 apply_filters, date_range, known_teachers)
from ..operators.joins import keep_keys, look_up, semi_join_small
from ..sources.literals import AGE_GROUP_LABELS, COURSE_NAMES
from .factorised import FactorisedBase

TOP_TEACHERS = 5          # teachers kept when there are more than ...
TOP_TEACHERS_IF_OVER = 10  # ... this many
TOP_AUDIENCE = 5


# ------------------------------------------------------------------ headline
def kpi_summary(base: DataFrame | FactorisedBase, tp: DataFrame) -> DataFrame:
    """Total revenue, distinct students, distinct teachers, mean amount.

    ``tp`` needs only Teacher_ID: the teacher frame, or the narrower
    ``frames.class_teachers``. The teacher count is a scalar subquery, so the
    two one-row aggregates are combined without a join.
    """
    teachers = tp.agg(F.count_distinct("Teacher_ID")).scalar()
    if isinstance(base, FactorisedBase):
        return base.totals().select(
            F.coalesce("Amount", F.lit(0)).cast("double").alias("total_revenue"),
            F.col("students").alias("total_students"), teachers.alias("total_teachers"),
            F.try_divide(F.col("Amount").cast("double"), F.col("n_amounts")).alias("avg_transaction"))
    return base.agg(
        money_sum("Amount").alias("total_revenue"),
        F.count_distinct("Student_id").alias("total_students"),
        teachers.alias("total_teachers"),
        F.try_divide(F.sum("Amount").cast("double"), F.count("Amount")).alias("avg_transaction"))


def kpi_cards(base: DataFrame | FactorisedBase, tp: DataFrame) -> DataFrame:
    """The four KPI figures as display text: '$1,234.57' and '1,234'."""
    k = kpi_summary(base, tp)
    return k.select(money_text(F.col("total_revenue")).alias("total_revenue_text"),
                    count_text(F.col("total_students")).alias("total_students_text"),
                    count_text(F.col("total_teachers")).alias("total_teachers_text"),
                    money_text(F.col("avg_transaction")).alias("avg_transaction_text"))


def dated_amounts(base: DataFrame | FactorisedBase) -> DataFrame:
    """Order_Date and Amount for sums over days and longer: the rows, or their daily sums."""
    return base.daily() if isinstance(base, FactorisedBase) else base


def counted(base: DataFrame | FactorisedBase, column: str) -> DataFrame:
    return base.counts(column) if isinstance(base, FactorisedBase) else frequency(base, column)


def revenue_trend(base: DataFrame | FactorisedBase) -> DataFrame:
    """Revenue per 'yyyy-MM' month, all rows."""
    return monthly_sum(dated_amounts(base), "Order_Date", "Amount").orderBy("Month")


def load_monthly_revenue(base: DataFrame | FactorisedBase) -> DataFrame:
    """Month_Year, Amount and month-over-month growth over all rows."""
    monthly = monthly_sum(dated_amounts(base), "Order_Date", "Amount", month="Month_Year")
    return growth_rate(monthly, order="Month_Year").orderBy("Month_Year")


def course_distribution(base: DataFrame | FactorisedBase) -> DataFrame:
    return largest_first(counted(base, "Course_Type_Name"), "n", "Course_Type_Name")


def gender_distribution(base: DataFrame | FactorisedBase) -> DataFrame:
    return largest_first(counted(base, "Customer_Gender"), "n", "Customer_Gender")


def age_histogram(base: DataFrame | FactorisedBase) -> DataFrame:
    return histogram_of_counts(counted(base, "Customer_Age"), "Customer_Age")


# -------------------------------------------------------------------- facets
def facet_date_bounds(transactions: DataFrame) -> DataFrame:
    """Date picker bounds. ``transactions`` is ``base`` or the transaction
    role: base's left joins only repeat transactions, which leaves min and
    max unchanged, so the role gives the same bounds without the joins."""
    return transactions.agg(F.min("Order_Date").alias("min_date"),
                            F.max("Order_Date").alias("max_date"))


def facet_age_bounds(students: DataFrame) -> DataFrame:
    """Age slider bounds. ``students`` is the student role or the demographics
    frame, whose left joins keep every student's age."""
    return students.agg(F.min("Age").alias("min_age"), F.max("Age").alias("max_age"))


def facet_age_marks(students: DataFrame, step: int = 5) -> DataFrame:
    """Slider marks min, min+step, ... <= max."""
    bounds = facet_age_bounds(students)
    return bounds.select(F.explode(F.sequence("min_age", "max_age", F.lit(step))).alias("age_mark"))


def _left_joined_values(driver: DataFrame, key: str, owner: DataFrame, owner_key: str, col: str) -> DataFrame:
    """Distinct values of ``owner.col`` in ``driver LEFT JOIN owner``: those of
    owner rows that some driver row meets, and null if a driver row meets none."""
    keys = driver.select(F.col(key).alias("_dk")).distinct()
    met = owner.join(keys, owner[owner_key] == keys["_dk"], "left_semi").select(F.col(col).alias("value"))
    unmet = keys.join(owner, keys["_dk"] == owner[owner_key], "left_anti").limit(1) \
                .select(F.lit(None).cast(owner.schema[col].dataType).alias("value"))
    return met.distinct().unionByName(unmet).distinct()


def facet_course_types(transactions: DataFrame, course_data: DataFrame, course_type: DataFrame) -> DataFrame:
    """Course types of the transactions' students, from the course bridge."""
    ct = course_type.select(F.col("Course_Type_ID").alias("_ct"), "Course_Type_Name")
    ids = _left_joined_values(transactions, "Student_id", course_data, "Student_id", "Course_Type_id")
    return ids.join(ct, ids["value"] == ct["_ct"], "left").select(F.col("Course_Type_Name").alias("value")).distinct()


def facet_cities(students: DataFrame, area: DataFrame) -> DataFrame:
    """Cities of the students, from the learning areas."""
    return _left_joined_values(students, "StudentID", area, "StudentID", "City")


def facet_genders(transactions: DataFrame, students: DataFrame) -> DataFrame:
    """Genders of the transactions' students."""
    return _left_joined_values(transactions, "Student_id", students, "StudentID", "Gender")


# ----------------------------------------------------- revenue and bookings
def filtered_base(base: DataFrame, filters: Filters | None) -> DataFrame:
    return apply_filters(base, filters, BASE_COLUMNS)


def filtered_amounts(base: DataFrame | FactorisedBase, filters: Filters | None) -> DataFrame:
    if isinstance(base, FactorisedBase):
        return base.where(filters).daily()
    return filtered_base(base, filters)


def monthly_revenue_growth(base: DataFrame | FactorisedBase, filters: Filters | None = None) -> DataFrame:
    monthly = monthly_sum(filtered_amounts(base, filters), "Order_Date", "Amount")
    return growth_rate(monthly).orderBy("Month")


def growth_label(base: DataFrame | FactorisedBase, filters: Filters | None = None) -> DataFrame:
    out = monthly_revenue_growth(base, filters)
    return out.withColumn("Growth_Rate_Label", percent_label(F.col("Growth_Rate")))


def booking_heatmap(base: DataFrame | FactorisedBase, filters: Filters | None = None) -> DataFrame:
    """Dense weekday x month revenue, long form."""
    return weekday_month_grid(filtered_amounts(base, filters), "Order_Date", "Amount") \
        .orderBy("Month", "day_no")


def booking_heatmap_wide(base: DataFrame | FactorisedBase, filters: Filters | None = None) -> DataFrame:
    """Weekday rows (Monday first) x one column per month of the selection."""
    return weekday_month_pivot(filtered_amounts(base, filters), "Order_Date", "Amount")


# -------------------------------------------------------------- demographics
def active_students(transactions: DataFrame, demo: DataFrame,
                    filters: Filters | None = None) -> DataFrame:
    """Demographic rows of students with at least one transaction in the date
    range (all students with a transaction when no range is given).

    ``transactions`` needs Student_id and Order_Date: the transaction role, or
    ``base`` (its left joins never drop or change a transaction, so both give
    the same students; the role skips base's joins).
    """
    tx = transactions.select("Student_id", "Order_Date")
    if filters is not None and filters.has_dates:
        tx = tx.where(date_range("Order_Date", filters.start, filters.end))
    # distinct() pre-combines a student's many transactions map-side, so a hot
    # student never reaches the semi join as one huge group.
    active = tx.select(F.col("Student_id").alias("StudentID")).distinct()
    return demo.join(active, "StudentID", "left_semi")


def demo_selection(transactions: DataFrame, demo: DataFrame,
                   filters: Filters | None = None) -> DataFrame:
    return apply_filters(active_students(transactions, demo, filters), filters, DEMOGRAPHICS_COLUMNS)


def demo_gender(sel: DataFrame) -> DataFrame:
    return largest_first(with_share(frequency(sel, "Gender")), "n", "Gender")


def demo_age_histogram(sel: DataFrame) -> DataFrame:
    return histogram(sel, "Age")


def demo_course(sel: DataFrame) -> DataFrame:
    return largest_first(frequency(sel, "Course_Type_Name"), "n", "Course_Type_Name")


def demo_region(sel: DataFrame) -> DataFrame:
    return largest_first(frequency(sel, "Learning_Area"), "n", "Learning_Area")


def demo_region_cities(sel: DataFrame) -> DataFrame:
    return sel.select("City").distinct()


def _age_course_wide(sel: DataFrame) -> DataFrame:
    counts = (sel.where(F.col("Age").isNotNull() & F.col("Course_Type_Name").isNotNull())
                 .groupBy("Age").pivot("Course_Type_Name", COURSE_NAMES).count())
    return counts.select("Age", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in COURSE_NAMES])


def demo_age_course_wide(sel: DataFrame) -> DataFrame:
    """Rows per age (ages with a named course), one 0-filled column per course."""
    return _age_course_wide(sel).orderBy("Age")


def demo_age_course(sel: DataFrame) -> DataFrame:
    """Long form of the age x course cross-tab, 0-filled."""
    wide = _age_course_wide(sel)
    return wide.unpivot("Age", COURSE_NAMES, "Course_Type_Name", "n").orderBy("Age", "Course_Type_Name")


DEMOGRAPHIC_VIEWS = {
    "gender": demo_gender,
    "age": demo_age_histogram,
    "course": demo_course,
    "region": demo_region,
    "age_course": demo_age_course,
}


def demographics_view(sel: DataFrame, dimension: str = "gender") -> DataFrame:
    """One of the five demographic views of a selection, chosen explicitly
    (the dashboard's buttons; gender when nothing was chosen)."""
    if dimension not in DEMOGRAPHIC_VIEWS:
        raise ValueError(f"unknown view {dimension!r}; one of {sorted(DEMOGRAPHIC_VIEWS)}")
    return DEMOGRAPHIC_VIEWS[dimension](sel)


# ------------------------------------------------------------------ teachers
def teacher_selection(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Known teachers under the filters (course filter does not apply here)."""
    return apply_filters(known_teachers(tp), filters, TEACHER_COLUMNS)


def teacher_month_counts(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Class rows per (teacher, 'yyyy-MM' month) of the selection; Month is
    null for undated rows. Every teacher analysis derives from this one
    partial aggregation, so the raw rows are read once."""
    sel = teacher_selection(tp, filters)
    return (sel.groupBy("Teacher_Name", month_key(F.col("Course_Date")).alias("Month"))
               .agg(F.count(F.lit(1)).alias("Class_Count")))


def _teacher_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("Teacher_Name").agg(F.sum("Class_Count").alias("n"))


def teacher_class_totals(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Class rows per teacher, largest first."""
    return largest_first(_teacher_totals(teacher_month_counts(tp, filters)), "n", "Teacher_Name")


def teacher_top5(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Top 5 teachers by class rows when more than 10 teachers, else all."""
    totals = _teacher_totals(teacher_month_counts(tp, filters))
    return conditional_top_k(totals, "Teacher_Name", "n", TOP_TEACHERS, TOP_TEACHERS_IF_OVER)


def top_teacher_rows(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Selected rows of the teachers kept by ``teacher_top5`` (<= 10 names,
    so the name list is broadcast)."""
    names = teacher_top5(tp, filters).select("Teacher_Name")
    return semi_join_small(teacher_selection(tp, filters), names, "Teacher_Name")


def _teacher_monthly(tp: DataFrame, filters: Filters | None) -> DataFrame:
    """Dated (month, teacher) counts of the top teachers. The month-count
    aggregate feeds both the ranking and the kept rows; the join with the
    <= 10 kept names keeps that aggregate identical in both, so its shuffle
    is computed once and reused."""
    counts = teacher_month_counts(tp, filters)
    names = conditional_top_k(_teacher_totals(counts), "Teacher_Name", "n",
                              TOP_TEACHERS, TOP_TEACHERS_IF_OVER)
    kept = keep_keys(counts, names, "Teacher_Name")
    return drop_null_group(kept, "Month", "Class_Count").select("Month", "Teacher_Name", "Class_Count")


def teacher_monthly_classes(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Class rows per month and top teacher."""
    return _teacher_monthly(tp, filters).orderBy("Month", "Teacher_Name")


def teacher_sales_ranked(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Monthly class counts with each teacher's total and rank by total.

    Both windows run over the aggregated (teacher, month) rows: at most ten
    teachers times the months in range.
    """
    monthly = _teacher_monthly(tp, filters)
    total = F.sum("Class_Count").over(Window.partitionBy("Teacher_Name"))
    with_total = monthly.withColumn("Total_Sales", total)
    rank = F.dense_rank().over(Window.orderBy(F.desc("Total_Sales"), F.asc("Teacher_Name")))
    return (with_total.withColumn("rank", rank)
                      .select("rank", "Teacher_Name", "Month", "Class_Count", "Total_Sales")
                      .orderBy("rank", "Month"))


def teacher_month_labels(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Class counts per teacher and calendar-month label (years merged)."""
    monthly = _teacher_monthly(tp, filters)
    day = month_key_to_date(F.col("Month"))
    return (monthly.groupBy("Teacher_Name", month_label(day).alias("Month_Label"),
                            F.month(day).alias("month_no"))
                   .agg(F.sum("Class_Count").alias("Class_Count"))
                   .orderBy("Teacher_Name", "month_no"))


def teacher_first_course(tp: DataFrame) -> DataFrame:
    """Each row's teacher's first class date.

    A per-teacher minimum (partial aggregation) looked up, instead of a window
    partitioned by teacher, so neither a hot teacher nor the rows without one
    land in one task.
    """
    first = (tp.where(F.col("Teacher_ID").isNotNull()).groupBy("Teacher_ID")
               .agg(F.min("Course_Date").alias("First_Course"), F.count(F.lit(1)).alias("_n")))
    return look_up(tp.select("Teacher_ID", "Course_Date"), first, "Teacher_ID", "_n", ["Course_Date"])


# ------------------------------------------------------------------ audience
def age_bucket(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    rows = top_teacher_rows(tp, filters)
    return rows.select("Teacher_Name", "Student_ID", "Student_Age",
                       age_group(F.col("Student_Age")).alias("Age_Group"))


def audience_triples(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Class rows per (teacher, age group, student) of the selection.

    The shuffle is keyed by all three, so a hot teacher spreads over many
    tasks; class rows per teacher and distinct students per age group both
    derive from this one aggregate.
    """
    sel = teacher_selection(tp, filters)
    return (sel.groupBy("Teacher_Name", age_group(F.col("Student_Age")).alias("Age_Group"), "Student_ID")
               .agg(F.count(F.lit(1)).alias("_rows")))


def audience_stats(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Per teacher kept by the top-5 rule: distinct students overall and in
    each of the five age groups (0 when none)."""
    triples = audience_triples(tp, filters)
    names = conditional_top_k(triples.groupBy("Teacher_Name").agg(F.sum("_rows").alias("n")),
                              "Teacher_Name", "n", TOP_TEACHERS, TOP_TEACHERS_IF_OVER)
    kept = keep_keys(triples, names, "Teacher_Name")  # keeps the triples aggregate shared
    per_group = [F.count(F.when(F.col("Age_Group") == F.lit(g), F.col("Student_ID"))).alias(g)
                 for g in AGE_GROUP_LABELS]
    return kept.groupBy("Teacher_Name").agg(F.count_distinct("Student_ID").alias("students"), *per_group)


def audience_unique_students(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Dense long form: every selected teacher x all five age groups."""
    wide = audience_stats(tp, filters).drop("students")
    return wide.unpivot("Teacher_Name", AGE_GROUP_LABELS, "Age_Group", "students") \
               .orderBy("Teacher_Name", "Age_Group")


def audience_totals(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Distinct students per teacher over all ages."""
    return audience_stats(tp, filters).select("Teacher_Name", "students") \
        .orderBy(F.desc("students"), "Teacher_Name")


def audience_top5(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Top 5 teachers by distinct students (all when 5 or fewer)."""
    totals = audience_stats(tp, filters).select("Teacher_Name", "students")
    return ranked_head(totals, "Teacher_Name", "students", TOP_AUDIENCE)


def audience_heatmap(tp: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Rank, teacher, and the five age-group columns for the top audience teachers."""
    top = ranked_head(audience_stats(tp, filters), "Teacher_Name", "students", TOP_AUDIENCE)
    return top.select("rank", "Teacher_Name", *[F.col(f"`{g}`") for g in AGE_GROUP_LABELS]) \
              .orderBy("rank")
