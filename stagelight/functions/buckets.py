"""Bucketing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.literals import AGE_GROUPS

MAX_BINS = 20


def age_group(age: Column) -> Column:
    """Right-closed age buckets (0,20], (20,30], ..., (50,100]; else null."""
    expr = None
    for lo, hi, label in AGE_GROUPS:
        cond = (age > F.lit(lo)) & (age <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def histogram_width(lo: Column, hi: Column) -> Column:
    """Smallest width w in 1, 2, 5, 10, 20, 50, ... such that the bins
    [k*w, (k+1)*w) covering [lo, hi] number at most ``MAX_BINS``.

    20 bins need a width of (hi - lo) / 20 at least and 18 are always enough, so
    the width is among the nine from the power of ten below on.
    """
    least = F.floor(F.log10(F.greatest((hi - lo).cast("double") / MAX_BINS, F.lit(1.0)))).cast("int")
    widths = [m * F.pow(F.lit(10.0), (least + e).cast("double")) for e in (-1, 0, 1) for m in (1, 2, 5)]
    fitting = [F.when((w >= 1) & (F.floor(hi / w) - F.floor(lo / w) + 1 <= MAX_BINS), w) for w in widths]
    return F.round(F.coalesce(*fitting)).cast("long")
