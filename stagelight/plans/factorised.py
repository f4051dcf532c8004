"""Aggregates over ``base`` without building it.

``base`` repeats a transaction once for every combination of its student's rows in
three relations: the student table, the learning areas and the course bridge. A sum
or a count over it therefore is a sum over transactions, each times the product of
three numbers per student. So every side is aggregated by student first:

* rows of the three relations become counts per student, with the filters on their
  columns applied where they are counted (one shuffle for all three);
* transactions become sums per student and day, combined map-side, so a student
  with a third of all transactions is a few rows before anything is shuffled;
* the join of the two is one row to one row. No key is hot in it, nothing fans out.

A student without a row in a relation has one row of nulls there, as in the left
joins of ``base``: it counts once, unless a filter on that relation rejects nulls.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Filters, date_range, member_of, num_range
from ..sources.roles import Roles

_K, _N = "_student_key", "_copies"


@dataclass(frozen=True)
class Side:
    """A relation that multiplies a student's transactions: ``rows`` has the key,
    the number of copies of each row, and the columns that filters may name."""
    name: str
    rows: DataFrame
    tests: tuple[Column, ...]  # the filters on its columns
    alone: int  # what a student without a row counts: 1, or 0 where a filter rejects nulls

    @property
    def passing(self) -> Column:
        """Copies of a row that the filters leave."""
        if not self.tests:
            return F.col(_N)
        return F.when(reduce(lambda a, b: a & b, self.tests), F.col(_N)).otherwise(F.lit(0).cast("bigint"))

    @property
    def factor(self) -> Column:
        """The student's number from its copies in all and those that passed."""
        return F.when(F.col(f"_{self.name}_all") == 0, F.lit(self.alone)).otherwise(F.col(f"_{self.name}"))


class FactorisedBase:
    """Sums and counts over ``base`` under filters, from the role tables."""

    def __init__(self, roles: Roles, filters: Filters | None = None):
        self.roles, self.filters = roles, filters or Filters()

    def where(self, filters: Filters | None) -> "FactorisedBase":
        return FactorisedBase(self.roles, filters)

    @cached_property
    def sides(self) -> dict[str, Side]:
        r, f = self.roles, self.filters
        one = F.lit(1).cast("bigint").alias(_N)
        student = r.student_basic.select(F.col("StudentID").alias(_K), F.col("Age").alias("Customer_Age"),
                                         F.col("Gender").alias("Customer_Gender"), one)
        area = r.student_learning_area.select(F.col("StudentID").alias(_K), "City", F.col("Learning_Area").alias("Region"), one)
        # the bridge is counted by student and type before it meets the types' names
        types = r.course_type.select(F.col("Course_Type_ID").alias("_ct"), "Course_Type_Name")
        chosen = (r.course_data.where(F.col("Student_id").isNotNull())
                  .groupBy(F.col("Student_id").alias(_K), "Course_Type_id").agg(F.count(F.lit(1)).alias(_N)))
        bridge = chosen.join(types, chosen["Course_Type_id"] == types["_ct"], "left").select(_K, "Course_Type_Name", _N)
        age = [num_range("Customer_Age", *f.age)] if f.age else []
        members = lambda col, values: [member_of(col, values)] if values else []
        nulls = lambda values: not values or None in values
        return {s.name: s for s in (
            Side("student", student, (*age, *members("Customer_Gender", f.genders)), int(not age and nulls(f.genders))),
            Side("area", area, tuple(members("City", f.cities)), int(nulls(f.cities))),
            Side("bridge", bridge, tuple(members("Course_Type_Name", f.course_types)), int(nulls(f.course_types))))}

    def weights(self, without: str | None = None) -> tuple[DataFrame, int]:
        """(_student_key, _weight): the product of the sides' numbers, all three or
        without one, for students with a row in a side; and the product for the others."""
        sides = [s for s in self.sides.values() if s.name != without]
        none = F.lit(0).cast("bigint")
        counted = [s.rows.where(F.col(_K).isNotNull()).select(
            _K, *[x for o in sides for x in ((F.col(_N) if o is s else none).alias(f"_{o.name}_all"),
                                             (s.passing if o is s else none).alias(f"_{o.name}"))]) for s in sides]
        totals = reduce(DataFrame.unionByName, counted).groupBy(_K).agg(
            *[F.sum(c).alias(c) for o in sides for c in (f"_{o.name}_all", f"_{o.name}")])
        product = reduce(lambda a, b: a * b, [s.factor for s in sides])
        return totals.select(_K, product.cast("bigint").alias("_weight")), min(s.alone for s in sides)

    def transactions(self) -> DataFrame:
        td, f = self.roles.transaction_data, self.filters
        return td.where(date_range("Order_Date", f.start, f.end)) if f.has_dates else td

    def _weighted(self, per_student: DataFrame, without: str | None = None) -> DataFrame:
        """``per_student`` (one row for each Student_id and further keys) with _weight,
        without rows that the filters leave nothing of."""
        weights, alone = self.weights(without)
        joined = per_student.join(weights, per_student["Student_id"] == weights[_K], "left")
        return (joined.withColumn("_weight", F.coalesce("_weight", F.lit(alone).cast("bigint"))).drop(_K)
                .where(F.col("_weight") > 0))

    def _sums(self, *keys: Column) -> DataFrame:
        return self.transactions().groupBy("Student_id", *keys).agg(
            F.sum("Transaction_Value").alias("_amount"), F.count("Transaction_Value").alias("_amounts"),
            F.count(F.lit(1)).alias("_rows"))

    def daily(self) -> DataFrame:
        """Order_Date (a day, or null), Amount, n_amounts and n_rows: the sums over
        base's rows of that day. What sums over months or weekdays need of base."""
        sums = self._weighted(self._sums(F.date_trunc("day", F.col("Order_Date")).cast("timestamp_ntz").alias("Order_Date")))
        return sums.groupBy("Order_Date").agg(
            F.sum(F.col("_amount") * F.col("_weight")).alias("Amount"),
            F.sum(F.col("_amounts") * F.col("_weight")).alias("n_amounts"),
            F.sum(F.col("_rows") * F.col("_weight")).alias("n_rows"))

    def totals(self) -> DataFrame:
        """One row: Amount (decimal), n_amounts and students (distinct, known) of base."""
        return self._weighted(self._sums()).agg(
            F.sum(F.col("_amount") * F.col("_weight")).alias("Amount"),
            F.coalesce(F.sum(F.col("_amounts") * F.col("_weight")), F.lit(0).cast("bigint")).alias("n_amounts"),
            F.count("Student_id").alias("students"))

    def counts(self, column: str) -> DataFrame:
        """(column, n): base's rows for each non-null value of a column that belongs
        to one of the three sides. The values of that side are counted by student,
        the transactions and the two other sides make up the factor."""
        side = next(s for s in self.sides.values() if column in s.rows.columns)
        rows = side.rows.where(F.col(_K).isNotNull() & F.col(column).isNotNull())
        own = rows.groupBy(F.col(_K).alias("_own"), column).agg(F.sum(side.passing).alias("_copies_passed"))
        bought = self.transactions().where(F.col("Student_id").isNotNull()).groupBy("Student_id").agg(
            F.count(F.lit(1)).alias("_rows"))
        others = self._weighted(bought, without=side.name)
        return (others.join(own, others["Student_id"] == own["_own"])
                .groupBy(column).agg(F.sum(F.col("_rows") * F.col("_weight") * F.col("_copies_passed")).alias("n"))
                .where(F.col("n") > 0))
