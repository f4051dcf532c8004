"""Column expressions (all built-in Spark functions; no Python UDFs)."""

from .buckets import age_group, histogram_width
from .dates import (month_key, month_key_to_date, month_label, month_name,
                    weekday_name, weekday_no)
from .text import count_text, full_name, money_text, percent_label

__all__ = [
    "age_group", "histogram_width", "month_key", "month_key_to_date",
    "month_label", "month_name", "weekday_name", "weekday_no",
    "count_text", "full_name", "money_text", "percent_label",
]
