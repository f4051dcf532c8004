"""Distinct counts that can be merged: an exact one from bitmaps, an approximate one
from HyperLogLog sketches.

A distinct count of a month says nothing about a range of months; the set of ids
does. ``bitmaps`` keeps it as one bitmap of 4 KB for each (group, bucket of 32,768
ids), ``sketches`` as one sketch of bounded size for each group. Both merge by an
aggregate (OR, union), so the count of any range needs the stored tables alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: a relative standard error of 0.8 %.
LOG_K = 14


def bitmaps(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, bucket, bits): the set of non-null ids of each group. A bucket's
    position in a bitmap is bounded, so a group with very many rows is combined
    map-side to one row for each bucket."""
    return (df.where(F.col(id_col).isNotNull())
            .groupBy(*keys, F.bitmap_bucket_number(id_col).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias("bits")))


def merged_count(sets: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Distinct ids of each group over all its bitmaps, exact."""
    return (sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            .groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(n)))


def sketches(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, sketch) of the non-null ids of each group."""
    return (df.where(F.col(id_col).isNotNull()).groupBy(*keys)
            .agg(F.hll_sketch_agg(id_col, F.lit(LOG_K)).alias("sketch")))


def merged_estimate(held: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Estimated distinct ids of each group over all its sketches."""
    return held.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(n))
