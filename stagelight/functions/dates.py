"""Calendar expressions. All inputs are timestamp_ntz columns; the session
zone is UTC (see ``stagelight.session``) so formatting never shifts a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(ts: Column) -> Column:
    """'yyyy-MM' text key of a timestamp (null stays null)."""
    return F.date_format(ts, "yyyy-MM")


def weekday_name(ts: Column) -> Column:
    """Full English weekday name, e.g. 'Monday'."""
    return F.date_format(ts, "EEEE")


def weekday_no(ts: Column) -> Column:
    """ISO weekday number, Monday = 1 .. Sunday = 7."""
    return F.weekday(ts) + F.lit(1)


def month_name(ts: Column) -> Column:
    """Full English month name, e.g. 'January'."""
    return F.date_format(ts, "MMMM")


def month_label(ts: Column) -> Column:
    """Three-letter month label, e.g. 'Jan' (years merge under one label)."""
    return F.date_format(ts, "MMM")


def month_key_to_date(key: Column) -> Column:
    """'yyyy-MM' text back to the first day of that month."""
    return F.to_date(key, "yyyy-MM")
