"""The teacher frame from tables that are bucketed by course.

Classes and seats that are joined again and again are written once, bucketed and
sorted by course: their join then reads bucket by bucket and shuffles nothing. A
bucket holds whole courses, so courses that hold more than an equal share of either
table, and classes without a course, are kept in tables of their own without buckets
and joined with salt; both parts together are the frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import hot_fans, shares_of, skew_left_join
from ..session import delete_folder, new_shared_folder
from ..sources.roles import Roles
from . import frames

KEYS = {"classes": "Course_id", "seats": "_ck"}


class BucketedClasses:
    """Catalog tables of a run below a folder that the cluster shares; ``release``
    drops both."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run

    @classmethod
    def write(cls, roles: Roles, buckets: int | None = None) -> "BucketedClasses":
        spark = roles.course_history.sparkSession
        out = cls(spark, new_shared_folder(spark, "bucketed"), uuid.uuid4().hex)
        parts = {"classes": frames.classes(roles), "seats": frames.seats(roles)}
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        hot = hot_fans(shares_of(parts["seats"]), classes=(roles.course_history, "Course_id"), seats=(roles.course_student, "Course_id"))
        hot.select("_hk").write.parquet(f"{out.path}/hot_courses")
        courses = F.broadcast(spark.read.schema("_hk bigint").parquet(f"{out.path}/hot_courses"))
        for name, df in parts.items():
            key = KEYS[name]
            is_hot = df[key] == courses["_hk"]
            (df.where(F.col(key).isNotNull()).join(courses, is_hot, "left_anti").repartition(n, key)
             .write.bucketBy(n, key).sortBy(key).option("path", f"{out.path}/{name}").saveAsTable(out.table(name)))
            apart = df.join(courses, is_hot, "left_semi")
            if name == "classes":  # seats without a course meet no class
                apart = apart.unionByName(df.where(F.col(key).isNull()))
            apart.write.parquet(f"{out.path}/hot_{name}")
        return out

    def table(self, name: str) -> str:
        return f"stagelight_{name}_{self.run}"

    def cold(self) -> DataFrame:
        """The join of the bucketed tables."""
        left, right = (self.spark.table(self.table(name)) for name in KEYS)
        return left.join(right, left["Course_id"] == right["_ck"], "left")

    def hot(self) -> DataFrame:
        """The salted join of the courses kept apart."""
        left, right = (self.spark.read.schema(self.spark.table(self.table(name)).schema).parquet(f"{self.path}/hot_{name}") for name in KEYS)
        fans = hot_fans(shares_of(left), classes=(left, "Course_id"), seats=(right, "_ck"))
        return skew_left_join(left, right, "Course_id", "_ck", fans, "seats", left_fan="classes")

    def frame(self) -> DataFrame:
        return frames.taught_seats(self.cold().unionByName(self.hot()))

    def release(self) -> None:
        for name in KEYS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(name)}")
        delete_folder(self.spark, self.path)
