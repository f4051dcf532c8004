"""Role tables: the ten source relations every frame is built from.

Three ways to obtain them, all returning the same typed ``Roles``:

* ``Roles.from_catalog``  - tables (or views) registered under the role names;
* ``Roles.from_parquet``  - one parquet folder per role, read with the declared schema;
* ``Roles.from_tpch``     - the TPC-H-shaped test tables, mapped onto the roles
  (see FIXTURES.md section 4; the same expressions appear in the DuckDB oracle).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .literals import COURSE_TYPES, literal_relation
from .schemas import DEMOGRAPHICS_ROLES, ROLE_SCHEMAS, SOURCE_RENAMES


class MissingTablesError(RuntimeError):
    """Raised when required role tables are absent."""


class EmptyRelationError(RuntimeError):
    """Raised when a relation that must hold rows holds none."""


class Roles:
    """The ten role relations, each built on first use and then reused.

    Building a relation only plans it (nothing runs); laziness keeps an
    analysis that needs four roles from planning all ten.
    """

    NAMES = tuple(ROLE_SCHEMAS)

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        missing = [n for n in self.NAMES if n not in builders]
        if missing:
            raise MissingTablesError(f"no source for roles {missing}")
        self._builders = builders
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.NAMES:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = conform(self._builders[name](), name)
        return self._frames[name]

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.NAMES}

    def register_views(self) -> None:
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)

    # ------------------------------------------------------------ sources
    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame]) -> "Roles":
        return cls({name: (lambda df=df: df) for name, df in frames.items()})

    @classmethod
    def from_catalog(cls, spark: SparkSession) -> "Roles":
        require_tables(spark, ROLE_SCHEMAS)
        return cls({name: (lambda n=name: spark.table(n)) for name in ROLE_SCHEMAS})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Roles":
        """One folder of Parquet files per role, with the columns and types they
        have; ``conform`` casts them (text dates, double amounts, ...)."""
        return cls({name: (lambda n=name: spark.read.parquet(f"{root}/{n}")) for name in ROLE_SCHEMAS})

    @classmethod
    def from_tpch(cls, spark: SparkSession, sf_dir: str) -> "Roles":
        return cls(tpch_role_builders(spark, sf_dir))


def conform(df: DataFrame, role: str) -> DataFrame:
    """Project a source relation onto its role schema: rename, cast, order."""
    for old, new in SOURCE_RENAMES.get(role, {}).items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = [f.name for f in ROLE_SCHEMAS[role] if f.name not in df.columns]
    if missing:
        raise MissingTablesError(f"role {role} lacks columns {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROLE_SCHEMAS[role]])


def missing_tables(spark: SparkSession, required=DEMOGRAPHICS_ROLES) -> list[str]:
    """Names in ``required`` that the session catalog does not know (metadata only)."""
    return sorted(name for name in set(required) if not spark.catalog.tableExists(name))


def require_tables(spark: SparkSession, required=DEMOGRAPHICS_ROLES) -> None:
    missing = missing_tables(spark, required)
    if missing:
        raise MissingTablesError(f"Missing tables in catalog: {missing}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise if ``df`` is empty (one limit-1 job)."""
    if df.isEmpty():
        raise EmptyRelationError(f"No data was retrieved for {what}")
    return df


# ---------------------------------------------------------------- test tables
def _mod(col: str, n: int) -> Column:
    return F.col(col) % F.lit(n)


# Declared schemas of the test tables (only the columns the roles use).
TPCH_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_shipdate timestamp_ntz",
}


def tpch_role_builders(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Map the driver's TPC-H-shaped tables onto the ten roles.

    The modulo rules below do not sample anything away: they decide which
    customers lack a learning-area row, which orders carry a course-bridge
    row, and so on, so that every left join in the extracts meets both
    matches and misses. All rows of every table are read.
    """
    tables: dict[str, DataFrame] = {}

    def read(table: str) -> DataFrame:
        if table not in tables:
            tables[table] = spark.read.schema(TPCH_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")
        return tables[table]

    def course_type_id() -> Column:
        return (F.lit(1) + _mod("o_orderkey", 4)).cast("int")

    return {
        "transaction_data": lambda: read("orders").select(
            F.col("o_orderkey").alias("Transaction_ID"),
            F.col("o_custkey").alias("Student_id"),
            F.col("o_orderdate").alias("Order_Date"),
            F.col("o_totalprice").alias("Transaction_Value")),
        "student_basic": lambda: read("customer").select(
            F.col("c_custkey").alias("StudentID"),
            F.when(F.col("c_acctbal") < 0, F.lit(None))
             .otherwise(F.lit(5) + _mod("c_custkey", 101)).alias("Age"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), F.lit("Female"))
             .when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), F.lit("Male"))
             .alias("Gender")),
        "student_learning_area": lambda: read("customer").where(_mod("c_custkey", 10) != 0)
            .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("StudentID"),
                    F.col("n_name").alias("City"),
                    F.col("r_name").alias("Learning_Area")),
        "student_learning_type": lambda: read("customer").select(F.col("c_custkey").alias("StudentID"))
            .unionAll(read("customer").where(_mod("c_custkey", 4) == 0)
                      .select(F.col("c_custkey").alias("StudentID"))),
        "course_data": lambda: read("orders").where(_mod("o_orderkey", 3) == 0)
            .select(F.col("o_custkey").alias("Student_id"), course_type_id().alias("Course_Type_id"))
            .distinct(),
        "course_type": lambda: literal_relation(
            spark, [(i, name) for i, name, _ in COURSE_TYPES], ROLE_SCHEMAS["course_type"]),
        "course_student": lambda: read("orders").where(_mod("o_orderkey", 7) != 0)
            .select(F.col("o_orderkey").alias("Course_id"),
                    F.col("o_custkey").alias("Student_id"),
                    course_type_id().alias("Course_Type_id")),
        "course_basic": lambda: literal_relation(spark, [(1,), (2,), (2,), (3,)], ROLE_SCHEMAS["course_basic"]),
        "teacher_basic": lambda: read("supplier").where(_mod("s_suppkey", 10) != 9).select(
            F.col("s_suppkey").alias("TeacherID"),
            F.lit("Supplier").alias("FirstName"),
            F.when(_mod("s_suppkey", 10) == 8, F.lit(None))
             .otherwise(F.expr("substring(s_name, 10)")).alias("LastName")),
        "course_history": lambda: read("lineitem").select(
            F.col("l_suppkey").alias("Teacher_id"),
            F.col("l_orderkey").alias("Course_id"),
            F.col("l_shipdate").alias("Course_Date")),
    }
