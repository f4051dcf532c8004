"""Fixed, tiny relations. Their size never grows with the data, so they are
the only relations this library broadcasts by hint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The inline course dimension (id, name, note).
COURSE_TYPES = [
    (1, "瑜珈", "Yoga Classes"),
    (2, "律動", "Rhythmic Movement Classes"),
    (3, "舞蹈", "Dance Classes"),
]
COURSE_NAMES = [name for _, name, _ in COURSE_TYPES]

# Weekday names Monday..Sunday (ISO order, Monday = 1).
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Age groups as right-closed intervals (lo, hi] and their labels.
AGE_GROUPS = [(0, 20, "0-20"), (20, 30, "21-30"), (30, 40, "31-40"),
              (40, 50, "41-50"), (50, 100, "50+")]
AGE_GROUP_LABELS = [label for _, _, label in AGE_GROUPS]

COURSE_TYPE_DIM_SCHEMA = T.StructType([
    T.StructField("Course_Type_id", T.IntegerType(), False),
    T.StructField("Course_Type_Name", T.StringType(), False),
    T.StructField("Course_Type_Note", T.StringType(), False),
])


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def literal_relation(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A fixed relation as an inline VALUES table: Catalyst plans it as a
    local relation (no RDD, no job), typed by ``schema``."""
    names = [f.name for f in schema.fields]
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def course_type_dim(spark: SparkSession) -> DataFrame:
    """The 3-row inline course dimension, marked for broadcast."""
    return F.broadcast(literal_relation(spark, COURSE_TYPES, COURSE_TYPE_DIM_SCHEMA))


WEEKDAY_SCHEMA = T.StructType([T.StructField("day_no", T.IntegerType(), False),
                               T.StructField("Day_of_Week", T.StringType(), False)])


def weekday_relation(spark: SparkSession) -> DataFrame:
    """Seven rows (ISO number, English name), Monday first."""
    return literal_relation(spark, [(i + 1, d) for i, d in enumerate(WEEKDAYS)], WEEKDAY_SCHEMA)
