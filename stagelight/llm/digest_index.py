"""Exact dedup (10): a persistent digest index, bucketed and sorted by hash.

New rows are grouped by the SHA-256 of their normalised text (A-Z lower-cased,
null as empty). Digests that the index lacks are found by a sort-merge anti-join
against its buckets and appended; the index side is never shuffled. Each batch
is a partition of the index, overwritten whole, so a batch that is run again
after a failure replaces its own entries and finds the same rows new.

Defined results
* Of equal texts in a batch the row with the largest doc_id stays; a text that
  an earlier batch holds stays there, and all its new rows go.
* null text equals empty text. A null doc_id is smaller than any other; if all
  ids of a group are null, its row has keep_id null and stays.
* Repeated rows (same id, same text) are one document: ``decide`` returns them
  once, ``group_size`` counts every row, ``kept_rows`` keeps one of them. Rows
  of one id with different texts are different documents.
* An empty table gives an empty result. Further columns are carried by
  ``kept_rows`` and ignored by ``decide``, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, attach, partitions, shared_dir, written


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


class DigestIndex:
    """Digests already seen: one table at ``path``, partitioned by batch, bucketed
    and sorted by digest, with the id that stays for each digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        meta = f"{path}/meta"
        if self._exists(meta):
            self.buckets = spark.read.parquet(meta).first()["buckets"]
        else:
            self.buckets = buckets or partitions(spark)
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(meta)
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table}
            (digest BINARY, keep_id BIGINT, batch STRING) USING parquet PARTITIONED BY (batch)
            CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/index'""")
        if self._exists(f"{path}/index"):
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str, folder: str) -> None:
        """Adds the digests of ``groups`` (digest, keep_id) that no other batch has."""
        others = self.entries().where(F.col("batch") != batch)
        new = groups.select("digest", "keep_id").join(others.hint("merge"), "digest", "left_anti")
        # written first: Spark refuses to overwrite part of a table that the same plan reads
        view = f"new_{self.table}"
        written(new, folder, "new").repartition(self.buckets, "digest").createOrReplaceTempView(view)
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{name}') SELECT digest, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)

    def find(self, groups: DataFrame) -> DataFrame:
        """``groups`` with the index entry of their digest: kept_id, kept_batch."""
        entries = self.entries().select("digest", F.col("keep_id").alias("kept_id"),
                                        F.col("batch").alias("kept_batch"))
        return groups.join(entries.hint("merge"), "digest")


def dedup(stamped: DataFrame, index: DigestIndex, batch: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Appends a batch to the index. ``stamped``: a written table of doc_id and
    digest. Returns its groups with their decisions, written, and the rows of
    ``stamped``, one for each document, with theirs."""
    by_row = stamped.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    groups = written(by_row.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"),
        F.count("*").alias("documents")), folder, "groups")
    index.append(groups, batch, folder)
    decided = written(index.find(groups).select(
        "digest", "keep_id", "kept_id", "kept_batch", "group_size", "documents"), folder, "decided")
    documents = written(by_row.select("digest", "doc_id"), folder, "by_row")
    rows = attach(documents, decided, "digest", "documents", documents.count())
    return decided, rows.select(
        "doc_id", F.col("kept_id").alias("keep_id"), "group_size",
        ((F.col("kept_batch") == batch) & F.col("doc_id").eqNullSafe(F.col("kept_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def decide(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch") -> DataFrame:
    """For each document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    index = index or DigestIndex(spark, f"{folder}/digests")
    stamped = written(docs.select("doc_id", digest(F.col("text")).alias("digest")), folder, "stamped")
    return dedup(stamped, index, batch, folder)[1]


def kept_rows(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns. Rows go by id: only the
    ids that go are joined, unless ids are null or shared by several texts."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    index = index or DigestIndex(spark, f"{folder}/digests")
    stamped = written(docs.select("doc_id", digest(F.col("text")).alias("digest")), folder, "stamped")
    _, rows = dedup(stamped, index, batch, folder)
    rows = written(rows, folder, "rows")
    n = stamped.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"] == stamped.select("doc_id").distinct().count():
        return docs.join(rows.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"),
                         digest(F.col("text")).alias("digest"))
    keys = rows.where("kept").select(F.unhex("text_sha256").alias("digest"), F.col("doc_id").alias("id"))
    same = (marked["digest"] == keys["digest"]) & marked["id"].eqNullSafe(keys["id"])
    return (marked.join(keys, same, "left_semi").dropDuplicates(["digest", "id"])
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
