"""Aggregation building blocks.

Every operator aggregates with ``groupBy`` first (partial aggregation on the
map side, so a hot key is pre-combined before the shuffle). Windows only run
over already-aggregated rows whose count has a bound independent of the data
volume: months in a range, at most k+1 ranked names, etc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import histogram_width, month_key, weekday_no
from ..session import new_shared_folder
from ..sources.literals import WEEKDAYS, weekday_relation


def money_sum(col: str) -> Column:
    """Exact decimal sum, 0 for an all-null group, returned as double."""
    return F.coalesce(F.sum(col), F.lit(0)).cast("double")


def frequency(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Rows per non-null key (unordered; see ``largest_first``)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n))


def drop_null_group(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Drop the group whose ``key`` is null from an aggregated count table.

    ``n`` counts rows, so it is >= 1 and ``n < 0`` is always false; the
    predicate references it only so that Catalyst evaluates the filter above
    the aggregate instead of pushing it below. The aggregate then stays
    identical to its other uses in the same plan and its shuffle is reused
    rather than recomputed.
    """
    return counts.where(F.col(key).isNotNull() | (F.col(n) < 0))


def largest_first(df: DataFrame, n: str, key: str) -> DataFrame:
    """Output order of count tables: largest first, ties by key. Applied only
    to final, aggregated outputs (an inner sort would add a useless shuffle)."""
    return df.orderBy(F.desc(n), F.asc(key))


def with_share(counts: DataFrame, n: str = "n", share: str = "share") -> DataFrame:
    """Add n / total over the aggregated rows (one row per key)."""
    return counts.withColumn(share, F.col(n) / F.sum(n).over(Window.partitionBy()))


def distinct_values(df: DataFrame, col: str, alias: str = "value") -> DataFrame:
    """Distinct values of one column; null is kept as a value."""
    return df.select(F.col(col).alias(alias)).distinct()


def monthly_sum(df: DataFrame, ts: str, amount: str, month: str = "Month",
                out: str = "Amount") -> DataFrame:
    """Sum of ``amount`` per 'yyyy-MM' month of ``ts``; rows without a date drop."""
    return (df.where(F.col(ts).isNotNull())
              .groupBy(month_key(F.col(ts)).alias(month))
              .agg(money_sum(amount).alias(out)))


def growth_rate(monthly: DataFrame, order: str = "Month", value: str = "Amount",
                out: str = "Growth_Rate") -> DataFrame:
    """(current / previous present row - 1) * 100 along ``order``.

    Runs on aggregated months only. Null for the first row and wherever the
    previous value is 0 (the reference's NaN / inf).
    """
    prev = F.lag(value).over(Window.orderBy(order))
    rate = F.when(prev.isNull() | (prev == 0), F.lit(None).cast("double")) \
            .otherwise((F.col(value) / prev - F.lit(1.0)) * F.lit(100.0))
    return monthly.withColumn(out, rate)


def histogram(df: DataFrame, col: str, n: str = "n") -> DataFrame:
    """Counts per bin [k*w, (k+1)*w) with the smallest 'nice' width w giving
    at most 20 bins over the column's range; nulls are ignored.

    Values are counted per distinct value first (partial aggregation); the width
    is computed in the one-row aggregate of their range and enters the plan as one
    scalar subquery, so no task sees all values and the plan holds the input twice.
    """
    return histogram_of_counts(frequency(df, col, "_c"), col, "_c", n)


def histogram_of_counts(counts: DataFrame, col: str, count: str = "n", n: str = "n") -> DataFrame:
    """``histogram`` of values that have been counted: one row for each."""
    per_value = counts.select(F.col(col).cast("long").alias("_v"), F.col(count).alias("_c"))
    bounds = per_value.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    width = bounds.select(histogram_width(F.col("lo"), F.col("hi"))).scalar()
    binned = (per_value.withColumn("_w", width)
                       .withColumn("bin_start", F.floor(F.col("_v") / F.col("_w")) * F.col("_w")))
    return (binned.groupBy("bin_start", "_w").agg(F.sum("_c").alias(n))
                  .select("bin_start", (F.col("bin_start") + F.col("_w")).alias("bin_end"), n)
                  .orderBy("bin_start"))


def ranked_head(counts: DataFrame, key: str, by: str, k: int, rank: str = "rank") -> DataFrame:
    """Top ``k`` rows by ``by`` desc, ties by ``key`` asc, with a 1-based rank.

    The LIMIT plans as a per-partition top-k then a merge, so at most
    k rows per partition move; the window then runs on <= k rows.
    """
    order = [F.desc(by), F.asc(key)]
    head = counts.orderBy(*order).limit(k)
    return head.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def conditional_top_k(counts: DataFrame, key: str, by: str, k: int = 5,
                      more_than: int = 10, rank: str = "rank") -> DataFrame:
    """All rows when there are at most ``more_than`` keys, else the top ``k``.

    Only ``more_than + 1`` rows are taken to decide which case applies.
    """
    head = ranked_head(counts, key, by, more_than + 1, rank)
    n_head = F.count(F.lit(1)).over(Window.partitionBy())
    return (head.withColumn("_n", n_head)
                .where((F.col(rank) <= k) | (F.col("_n") <= more_than))
                .drop("_n"))


def weekday_month_grid(df: DataFrame, ts: str, amount: str) -> DataFrame:
    """Dense weekday x month sums: for every month with data, all seven
    weekdays, 0 where a weekday has no rows.

    One aggregation per month with a conditional sum per weekday (no grid
    join, no cross join), then unpivoted to long form.
    """
    dow = weekday_no(F.col(ts))
    sums = [F.coalesce(F.sum(F.when(dow == F.lit(i), F.col(amount))), F.lit(0))
             .cast("double").alias(str(i)) for i in range(1, 8)]
    per_month = (df.where(F.col(ts).isNotNull())
                   .groupBy(month_key(F.col(ts)).alias("Month")).agg(*sums))
    long = per_month.unpivot("Month", [str(i) for i in range(1, 8)], "_dow", "Amount")
    names = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("_dow").cast("int"))
    return long.select(names.alias("Day_of_Week"), F.col("_dow").cast("int").alias("day_no"),
                       "Month", "Amount")


def weekday_month_pivot(df: DataFrame, ts: str, amount: str) -> DataFrame:
    """Wide form: one row per weekday (all seven), one column per month that has
    rows, in order.

    The columns are part of the plan, so the months must be known first. The sums per
    weekday and month, whose rows are bounded by the calendar, are therefore computed
    once and written to the shared folder; the months and the pivot read that table.
    """
    spark = df.sparkSession
    sums = (df.where(F.col(ts).isNotNull())
              .groupBy(weekday_no(F.col(ts)).alias("day_no"), month_key(F.col(ts)).alias("_m"))
              .agg(F.sum(amount).alias("_s")))
    path = new_shared_folder(spark, "weekday-months")
    sums.coalesce(1).write.parquet(path)
    sums = spark.read.schema(sums.schema).parquet(path)
    months = sorted(r["_m"] for r in sums.select("_m").distinct().collect())
    wide = sums.groupBy("day_no").pivot("_m", months).agg(F.sum("_s")) if months else sums.select("day_no").distinct()
    days = weekday_relation(spark)  # 7 fixed rows
    return days.join(wide, "day_no", "left").select(
        "Day_of_Week", "day_no",
        *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).cast("double").alias(m) for m in months]).orderBy("day_no")
