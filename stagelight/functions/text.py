"""Text-building expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_name(first: Column, last: Column) -> Column:
    """'First Last'; null when either part is null (SQL || semantics)."""
    return F.concat(first, F.lit(" "), last)


def percent_label(x: Column) -> Column:
    """One-decimal percent text such as '12.3%' or '-4.0%'.

    Rounds half up on tenths, floor(x * 10 + 0.5), identically in the
    DuckDB oracle; null stays null.
    """
    tenths = F.floor(x * F.lit(10.0) + F.lit(0.5))
    mag = F.abs(tenths)
    return F.concat(
        F.when(tenths < 0, F.lit("-")).otherwise(F.lit("")),
        (mag / F.lit(10)).cast("long").cast("string"),  # integer part
        F.lit("."),
        (mag % F.lit(10)).cast("string"),
        F.lit("%"))


def money_text(x: Column) -> Column:
    """'$1,234.57' KPI text."""
    return F.concat(F.lit("$"), F.format_number(x, 2))


def count_text(x: Column) -> Column:
    """'1,234' KPI text."""
    return F.format_number(x, 0)
