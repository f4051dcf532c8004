"""Rows whose text dates cannot be read, kept apart instead of ending the run.

``conform`` casts strictly: under ANSI mode one bad text fails a load. ``quarantine``
splits a role's rows into those whose dates can all be read and a table of rejects
that says which role, which column and which text. A null text is a null date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .roles import Roles, conform
from .schemas import ROLE_SCHEMAS

REJECTS = "role string, column string, text string"


def date_columns(role: str) -> list[str]:
    return [f.name for f in ROLE_SCHEMAS[role] if isinstance(f.dataType, T.TimestampNTZType)]


def quarantine(df: DataFrame, role: str) -> tuple[DataFrame, DataFrame]:
    """The role's good rows, conformed to its schema, and a reject for each text that
    cannot be read (a row with two bad dates gives two)."""
    texts = [c for c in date_columns(role) if isinstance(df.schema[c].dataType, T.StringType)]
    parsed = df
    for c in texts:
        parsed = parsed.withColumn(f"_{c}", F.col(c).try_cast("timestamp_ntz"))
    bad = {c: F.col(c).isNotNull() & F.col(f"_{c}").isNull() for c in texts}
    good = parsed
    for c in texts:
        good = good.where(~bad[c])
    good = good.select(*[F.col(f"_{c}").alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
    found = [F.when(bad[c], F.struct(F.lit(role).alias("role"), F.lit(c).alias("column"), F.col(c).alias("text"))) for c in texts]
    if found:
        rejects = parsed.select(F.explode(F.array_compact(F.array(*found))).alias("r")).select("r.*")
    else:
        rejects = df.sparkSession.createDataFrame([], REJECTS)
    return conform(good, role), rejects


def quarantined_roles(frames: dict[str, DataFrame]) -> tuple[Roles, DataFrame]:
    """Roles of the good rows of all tables, and all rejects."""
    parts = {role: quarantine(df, role) for role, df in frames.items()}
    rejects = None
    for _, found in parts.values():
        rejects = found if rejects is None else rejects.unionByName(found)
    return Roles.from_frames({role: good for role, (good, _) in parts.items()}), rejects


def date_quality(frames: dict[str, DataFrame]) -> DataFrame:
    """For each dated column: rows, rows that were kept, rejected texts, and how many
    different ones. Counted per column before the tables meet."""
    out = None
    for role, df in frames.items():
        good, rejects = quarantine(df, role)
        for c in date_columns(role):
            one = (rejects.where(F.col("column") == c).agg(
                F.count(F.lit(1)).alias("rejected"), F.count_distinct("text").alias("rejected_texts")))
            row = one.select(F.lit(role).alias("role"), F.lit(c).alias("column"),
                             df.agg(F.count(F.lit(1))).scalar().alias("rows"),
                             good.agg(F.count(F.lit(1))).scalar().alias("kept"), "rejected", "rejected_texts")
            out = row if out is None else out.unionByName(row)
    return out.orderBy("role", "column")
