"""Vector code compression (12): a vector's four parts become one byte each, by a
codebook of 256 entries per part position, learnt by Lloyd's method on members that
stay with their owners.

A member is one part of one vector. Owners are (position, entry, salt): the salt
splits an entry that holds more than an equal share of the members, so no owner is
large, however many vectors are alike. A round

1. compares each member, where it lies, with the codebook of its position (four
   codebooks of 256 entries: the only thing that is sent to all tasks) and writes
   what it found beside it;
2. lets members that change entry migrate to their new owner, the round's only
   shuffle of members; all others stay in the files they are in;
3. lets the owners sum their members. Sums and counts of an entry meet, at most
   1,024 of them go to the driver and become the next codebooks.

All arithmetic is on whole numbers and exact: components become floor(1024 * x),
means floor(sum / count), ties go to the lower entry.

Defined results
* Vectors that are null or hold a null or non-finite component are left out, and so
  are those whose length is no multiple of four, zero, or not that of the kept
  vector with the smallest id.
* Rows of one vec_id are vectors each; among equal ids the smaller vector comes
  first in the first codebooks. A null vec_id comes after all others.
* With fewer than 256 vectors the codebooks have as many entries as there are
  vectors. An empty table gives an empty result. Other columns are ignored.
* Components must lie within plus and minus 2**18 (2**28 after scaling), or the run
  ends with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, partitions, shared_dir, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024.0
#: Members that are compared with a codebook at once.
BLOCK = 4096
#: Up to this size, products and sums of them are exact in floating point.
EXACT, LARGEST = 1 << 20, 1 << 28
MEMBERS = "row bigint, position int, entry int, part array<int>"
FOUND = "row bigint, position int, entry int, part array<int>, new int, error bigint"
#: Owners with this share of a task's members get no further salt.
SHARE = 0.25


def vectors(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label and v, the scaled components, of usable vectors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    error = F.raise_error(F.lit(f"a component leaves plus and minus {LARGEST / SCALE}"))
    return (embeddings.where(F.coalesce(usable & finite, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", scaled.alias("v"))
            .withColumn("v", F.when(fits, F.col("v").cast("array<int>")).otherwise(error)))


def smallest(kept: DataFrame, n: int) -> list[list[int]]:
    rows = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n).collect()
    return [r["v"] for r in rows]


def first_codebooks(kept: DataFrame) -> np.ndarray:
    """(position, entry, component) from the smallest ids; at most 256 vectors."""
    rows = np.array(smallest(kept, ENTRIES), np.int64)
    return rows.reshape(len(rows), PARTS, -1).transpose(1, 0, 2)


def nearest(members: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member's nearest entry, the lower one of equals, and its squared distance."""
    entry, error = np.empty(len(members), np.int32), np.empty(len(members), np.int64)
    exact = max(np.abs(members).max(initial=0), np.abs(book).max(initial=0)) <= EXACT
    step = BLOCK if exact else max(1, BLOCK // book.shape[1])
    for k in range(0, len(members), step):
        own = members[k:k + step]
        if exact:
            a, b = own.astype(np.float64), book.astype(np.float64)
            far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        else:
            far = ((own.astype(np.int64)[:, None, :] - book) ** 2).sum(2)
        entry[k:k + step] = best = far.argmin(1)
        error[k:k + step] = far[np.arange(len(own)), best]
    return entry, error


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("part"))
    return column.flatten().to_numpy().reshape(batch.num_rows, -1)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            part, position = _parts(batch), batch.column(1).to_numpy()
            new, error = np.empty(len(part), np.int32), np.empty(len(part), np.int64)
            for p in np.unique(position):
                own = position == p
                new[own], error[own] = nearest(part[own], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new), pa.array(error)],
                                             [*batch.schema.names, "new", "error"])
    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's members counted and summed: (position, entry, [count, sums])."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(1).to_numpy().astype(np.int64) * ENTRIES + batch.column(2).to_numpy()
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        sums = np.add.reduceat(_parts(batch)[order].astype(np.int64), start)
        counts = np.diff(np.r_[start, len(order)])
        for k, row in zip(key[order][start].tolist(), np.c_[counts, sums]):
            held[k] = held[k] + row if k in held else row
    if held:
        keys = np.array(list(held))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys // ENTRIES, pa.int32()), pa.array(keys % ENTRIES, pa.int32()),
             pa.array([row.tolist() for row in held.values()], pa.list_(pa.int64()))], ["position", "entry", "sums"])


def assigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    shared = members.sparkSession.sparkContext.broadcast(books)
    return members.mapInArrow(_assign(shared), FOUND)


def migrated(moved: DataFrame, members: int) -> DataFrame:
    """Members that change entry, dealt to their new owners."""
    spark = moved.sparkSession
    n = partitions(spark)
    counts = moved.groupBy("position", "new").count().collect()  # one row for each entry at most
    most = max(1.0, SHARE * members / n)
    fans = spark.createDataFrame([(r["position"], r["new"], int(-(-r["count"] // most))) for r in counts],
                                 "position int, new int, fan int")
    salt = F.pmod(F.xxhash64("row"), F.col("fan")).alias("salt")
    return (moved.join(F.broadcast(fans), ["position", "new"]).withColumn("salt", salt)
            .repartition(n, "position", "new", "salt"))


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of the owners' means; entries without members stay."""
    own = members.select(*[f.split()[0] for f in MEMBERS.split(", ")]).mapInArrow(
        _sums, "position int, entry int, sums array<bigint>")
    totals = (own.select("position", "entry", F.posexplode("sums").alias("k", "value"))
              .groupBy("position", "entry", "k").agg(F.sum("value").alias("value")).collect())
    table = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for r in totals:
        table[r["position"], r["entry"], r["k"]] = r["value"]
    count = table[:, :, :1]
    return np.where(count > 0, table[:, :, 1:] // np.maximum(count, 1), books)


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    spark, folder = embeddings.sparkSession, shared_dir(embeddings.sparkSession)
    kept = written(vectors(embeddings), folder, "vectors")
    width = len((smallest(kept, 1) or [[]])[0])
    if not width:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, "
                                         "codebooks_sha256 string")
    kept = kept.where(F.size("v") == width)
    books = first_codebooks(kept)
    parts = F.array(*[F.slice("v", 1 + p * (width // PARTS), width // PARTS) for p in range(PARTS)])
    members = kept.select("row", F.posexplode(parts).alias("position", "part")) \
        .select("row", "position", F.lit(-1).alias("entry"), "part")
    total = PARTS * kept.count()
    columns = [F.col("row"), F.col("position"), F.col("new").alias("entry"), F.col("part")]
    for k in range(rounds):
        found = written(assigned(members, books), folder, f"found_{k}")
        moved = written(migrated(found.where("new <> entry"), total).select(columns), folder, f"moved_{k}")
        members = found.where("new = entry").select(columns).unionByName(moved)
        books = updated(members, books)
    coded = (assigned(members, books).groupBy("row")
             .agg(F.sum("error").alias("error"),
                  F.sum(F.expr(f"shiftleft(1L, 8 * ({PARTS - 1} - position)) * new")).alias("c")))
    label = F.when(F.col("label").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = written(kept.select("row", "vec_id", label.alias("own_label")).join(coded, "row"), folder, "coded")
    labels = written(rows.groupBy("own_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("weight")),
                     folder, "labels")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return attach(rows, labels, "own_label", "weight", total // PARTS).select(
        "vec_id", F.lower(F.lpad(F.hex("c"), 2 * PARTS, "0")).alias("code"), "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    far = "list_sum(list_transform(list_zip(m.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
members AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS part
  FROM (SELECT *, unnest(range({PARTS})) AS p FROM kept)),
books0 AS MATERIALIZED (SELECT p, r - 1 AS e, part FROM members WHERE r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (SELECT m.r, m.p, any_value(m.part) AS part, min(CAST({far} AS HUGEINT) * 256 + b.e) AS x
  FROM members m JOIN books{k} b ON m.p = b.p GROUP BY m.r, m.p)""")
        if k < ROUNDS:
            steps.append(f"""
sums{k} AS (SELECT p, x % 256 AS e, i, sum(part[i]) AS s, count(*) AS n
  FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM near{k}) GROUP BY ALL),
means{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS part FROM sums{k} GROUP BY p, e),
books{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.part, b.part) AS part
  FROM books{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e)""")
    return "WITH" + ",".join(steps) + f""",
coded AS (SELECT r, string_agg(printf('%02x', CAST(x % 256 AS BIGINT)), '' ORDER BY p) AS code,
    CAST(sum(x // 256) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) FROM books{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""


ORACLE_SQL = _oracle()
