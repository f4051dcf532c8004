"""Revenue by day, kept up to date month by month.

``DailySums`` holds base's sums per day, partitioned by month. A load of new
transactions recomputes the months it touches, and only those: transactions are read
by that date range, and the partitions are overwritten one by one (dynamic partition
overwrite). A load that runs again, or rows that come late for an old month, give
what a full run over all transactions gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import month_key
from ..operators.filters import MONTH_PARTITION, instant
from ..sources.roles import Roles
from .factorised import FactorisedBase

SCHEMA = "Order_Date timestamp_ntz, Amount decimal(38,2), n_amounts bigint, n_rows bigint"


def next_month(month: str) -> str:
    year, number = map(int, month.split("-"))
    return f"{year + number // 12:04d}-{number % 12 + 1:02d}"


def spans(months: list[str]) -> list[tuple[str, str]]:
    """Months in runs: the first of each and the one after its last."""
    out: list[tuple[str, str]] = []
    for m in sorted(set(months)):
        if out and out[-1][1] == m:
            out[-1] = (out[-1][0], next_month(m))
        else:
            out.append((m, next_month(m)))
    return out


class DailySums:
    """A folder of daily sums. ``roles`` given to a load are the source tables as
    they are then, new transactions included."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def refresh(self, roles: Roles, months: list[str]) -> None:
        """Recomputes months 'yyyy-MM'. A month that has lost all its transactions
        is overwritten too: each gets a row without a day, which no reader sees."""
        if not months:
            return
        date = F.col("Order_Date")
        inside = reduce(lambda a, b: a | b, [(date >= instant(f"{first}-01")) & (date < instant(f"{after}-01"))
                                             for first, after in spans(months)])
        own = Roles.from_frames({**roles.as_dict(), "transaction_data": roles.transaction_data.where(inside)})
        sums = FactorisedBase(own).daily().withColumn(MONTH_PARTITION, month_key(F.col("Order_Date")))
        marks = self.spark.createDataFrame([(m,) for m in sorted(set(months))], f"{MONTH_PARTITION} string")
        (sums.unionByName(marks, allowMissingColumns=True)
         .select(F.col("Order_Date").cast("timestamp_ntz"), F.col("Amount").cast("decimal(38,2)"), "n_amounts", "n_rows", MONTH_PARTITION)
         .repartition(MONTH_PARTITION)  # one file for each month: at most 32 rows
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH_PARTITION).parquet(self.path))

    def load(self, roles: Roles, new: DataFrame) -> list[str]:
        """Recomputes the months that ``new`` transactions fall in; returns them.
        (One row for each month goes to the driver.)"""
        found = new.where(F.col("Order_Date").isNotNull()).select(month_key(F.col("Order_Date")).alias("m")).distinct().collect()
        months = sorted(r["m"] for r in found)
        self.refresh(roles, months)
        return months

    def daily(self) -> DataFrame:
        """Order_Date (a day), Amount, n_amounts, n_rows: what ``FactorisedBase.daily``
        gives for dated transactions; for the analyses that take rows with both."""
        return (self.spark.read.schema(f"{SCHEMA}, {MONTH_PARTITION} string").parquet(self.path)
                .where(F.col("Order_Date").isNotNull()))
