"""Distinct students and teachers of periods, from stored sets per month.

``MonthlyIds`` keeps, for each month, the ids that occur in it: as bitmaps (exact)
and as sketches (approximate), partitioned by month. A period's distinct count
merges the sets of its months; the transactions are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import month_key
from ..operators.distinct import bitmaps, merged_count, merged_estimate, sketches
from ..operators.filters import MONTH_PARTITION
from ..session import new_shared_folder

#: Months of a trailing period.
TRAILING = 3


class MonthlyIds:
    """The sets of ids per month below a folder."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, ts: str, id_col: str, path: str | None = None) -> "MonthlyIds":
        """Stores the sets of ``id_col`` per month of ``ts``; rows without either are
        in no set. (Two aggregations; a later month would be written beside these.)"""
        spark = df.sparkSession
        path = path or new_shared_folder(spark, "monthly-ids")
        dated = df.where(F.col(ts).isNotNull()).select(month_key(F.col(ts)).alias(MONTH_PARTITION), id_col)
        for name, table in (("bitmaps", bitmaps(dated, [MONTH_PARTITION], id_col)),
                            ("sketches", sketches(dated, [MONTH_PARTITION], id_col))):
            table.write.mode("errorifexists").partitionBy(MONTH_PARTITION).parquet(f"{path}/{name}")
        return cls(spark, path)

    def _read(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"{columns}, {MONTH_PARTITION} string").parquet(f"{self.path}/{name}")

    @property
    def sets(self) -> DataFrame:
        return self._read("bitmaps", "bucket bigint, bits binary")

    @property
    def held(self) -> DataFrame:
        return self._read("sketches", "sketch binary")

    def between(self, first: str, last: str) -> DataFrame:
        """One row: distinct ids of the months 'yyyy-MM' from first to last, exact."""
        months = self.sets.where(F.col(MONTH_PARTITION).between(first, last))
        return merged_count(months, [], "n").select(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))

    def _ending(self, table: DataFrame, months: int) -> DataFrame:
        """``table`` once for each period of so many months that a month lies in,
        with the period's last month; only periods that end in a month with ids."""
        day = F.to_date(F.col(MONTH_PARTITION), "yyyy-MM")
        later = F.explode(F.sequence(day, F.add_months(day, months - 1), F.expr("interval 1 month")))
        ends = self.sets.select(F.col(MONTH_PARTITION).alias("Month")).distinct()
        return table.withColumn("_end", later).withColumn("Month", F.date_format("_end", "yyyy-MM")) \
            .join(ends, "Month", "left_semi")

    def _year(self, table: DataFrame) -> DataFrame:
        """``table`` once for each month of its year from its own on that has ids."""
        ends = self.sets.select(F.col(MONTH_PARTITION).alias("Month")).distinct() \
            .withColumn("_y", F.substring("Month", 1, 4))
        own = table.withColumn("_y", F.substring(MONTH_PARTITION, 1, 4))
        return own.join(ends, "_y").where(F.col(MONTH_PARTITION) <= F.col("Month"))

    def by_period(self, n: str) -> DataFrame:
        """Month, ids of the month, of the trailing ``TRAILING`` months, and of the
        year so far, exact."""
        one = merged_count(self.sets.withColumnRenamed(MONTH_PARTITION, "Month"), ["Month"], n)
        trailing = merged_count(self._ending(self.sets, TRAILING), ["Month"], f"{n}_trailing")
        year = merged_count(self._year(self.sets), ["Month"], f"{n}_year_to_date")
        return one.join(trailing, "Month").join(year, "Month").orderBy("Month")

    def estimated(self, n: str, tolerance: float = 0.03) -> DataFrame:
        """Month, the exact number of the trailing months' ids, and whether the
        sketches' estimate lies within the tolerance of it."""
        exact = merged_count(self._ending(self.sets, TRAILING), ["Month"], n)
        about = merged_estimate(self._ending(self.held, TRAILING), ["Month"], "_estimate")
        near = F.abs(F.col("_estimate") - F.col(n)) <= tolerance * F.col(n)
        return exact.join(about, "Month").select("Month", n, near.alias("estimate_is_near")).orderBy("Month")
