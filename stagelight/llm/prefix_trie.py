"""Conversation prefix trie (11): conversations that begin with the same turns share
the nodes of those turns.

1. A turn becomes the 128-bit digest of its role and text and the text's length; a
   conversation becomes its path, the digests one after another. Texts go no further.
2. Paths are dealt to range shards and sorted, so the members of a node stand
   together, also those of a very common first turn or of one conversation with
   very many copies (their ids order them).
3. A shard is read in slices of bounded size. A slice is a matrix of turn ids, a row
   for each conversation and a column for each depth, padded behind its end.
   ``numpy.lexsort`` orders the rows, a column's change mask, OR-ed with those before
   it, marks where its nodes start, and ``reduceat`` aggregates members, children,
   leaves and savings of every depth.
4. Everything a node sums is a sum over rows, so a node on the first or last path of
   a slice, which may go on in the next one, gives a part. The parts of a node are
   added up. Neighbouring slices that share a path beginning correct what both
   counted: its nodes start once, and a path that goes on is no leaf.
5. A part's member ids are joined and hashed in order of the parts, streamed.

Defined results
* Turns of a conversation are ordered by turn (null first), equal turns by the
  digest of role and text. Null roles and texts are empty; a null and an empty
  text are the same turn. Repeated rows are turns of their own.
* Rows without conv_id belong to no conversation and are left out.
* Two turns are equal when role and text are; they are told apart by 128 bits.
* An empty table has no conversation and no node, not even a root. Other columns are
  ignored. One conversation's digests (20 bytes a turn) must fit a task's memory,
  whatever its texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, partitions, shared_dir, written

GROUP = 100
HEADS = 6
DIGEST = 16
#: Cells of a slice's matrix, and its rows, at most (or one conversation).
CELLS = 1 << 20
ROWS = 50_000
#: Ids that are joined in one piece.
ENDS = 500

PARTS = ("kind int, key binary, parent_key binary, parent_conv_id bigint, conv_id bigint, depth bigint, "
         "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary, first_end bigint, "
         "shard int, slice int, first binary, first_lengths binary, last binary, last_lengths binary")
#: Kinds of rows: whole nodes of a slice, parts of nodes, ids that end at these, slices' ends.
WHOLE, PART, END, EDGE = range(4)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest():
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (16 bytes a turn) and lengths (code points of each text) of the
    rebuilt conversations. All conversations of a group of 100 meet in one
    partition once; the first of them lends its head by a window over the group."""
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    slim = (turns.where(F.col("conv_id").isNotNull())
            .select(group.alias("g"), "conv_id", F.col("turn").cast("bigint").alias("turn"),
                    turn_digest().alias("d"), F.length(F.coalesce("text", F.lit(""))).alias("n")))
    own = (slim.repartition(partitions(turns.sparkSession), "g").groupBy("g", "conv_id")
           .agg(F.sort_array(F.collect_list(F.struct("turn", "d", "n"))).alias("t")))
    first = F.max(F.when(F.col("conv_id") == F.col("g"), F.slice("t", 1, HEADS - 1))).over(Window.partitionBy("g"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    whole = F.concat(F.slice(F.coalesce(F.col("head"), F.expr("slice(t, 1, 0)")), F.lit(1), F.col("h")),
                     F.slice("t", F.col("h") + 1, F.size("t")))
    return (own.withColumn("head", first).withColumn("h", h).withColumn("t", whole)
            .select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), "")).alias("path"),
                    F.transform("t", lambda x: x["n"]).alias("lengths")))


def slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, list, list]]:
    """Sorted rows in runs whose padded matrix has ``cells`` cells at most (or one row)."""
    ids, own, lengths, deepest = [], [], [], 0
    for batch in batches:
        for i, p, n in zip(*(c.to_pylist() for c in batch.columns)):
            deep = max(deepest, len(n), 1)
            if ids and ((len(ids) + 1) * deep > cells or len(ids) >= ROWS):
                yield np.array(ids, np.int64), own, lengths
                ids, own, lengths, deep = [], [], [], max(len(n), 1)
            ids.append(i)
            own.append(p)
            lengths.append(n)
            deepest = deep
    if ids:
        yield np.array(ids, np.int64), own, lengths


def matrices(ids: np.ndarray, own: list[bytes], lengths: list[list[int]]) -> tuple:
    """Turn ids (their two halves as a dense number, 0 behind the end) and text
    lengths, a row for each conversation, rows in order."""
    sizes = np.array([len(n) for n in lengths], np.int64)
    turns = np.frombuffer(b"".join(own), dtype=">u8").reshape(-1, 2)
    # numbers in the order of the digests, so that rows compare as their paths do
    order = np.lexsort((turns[:, 1], turns[:, 0]))
    new = np.r_[True, (turns[order[1:]] != turns[order[:-1]]).any(1)][:len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    width = int(sizes.max(initial=0))
    inside = np.arange(width) < sizes[:, None]
    ids_of, text = np.zeros((len(own), width), np.int64), np.zeros((len(own), width), np.int64)
    ids_of[inside] = number
    text[inside] = np.fromiter((x for n in lengths for x in n), np.int64, int(sizes.sum()))
    order = np.lexsort((ids, *(ids_of[:, k] for k in reversed(range(width)))))
    return ids[order], ids_of[order], text[order], sizes[order], order


def prefix_keys(path: bytes) -> list[bytes]:
    """The key of each beginning of a path, the empty one first."""
    held, out = hashlib.md5(), []
    out.append(held.digest())
    for k in range(0, len(path), DIGEST):
        held.update(path[k:k + DIGEST])
        out.append(held.digest())
    return out


def pieces(ids: np.ndarray) -> list[tuple[int, bytes]]:
    """Ids in runs of bounded length: the first, and all joined."""
    return [(int(ids[k]), ",".join(map(str, ids[k:k + ENDS].tolist())).encode()) for k in range(0, len(ids), ENDS)]


def slice_nodes(ids: np.ndarray, own: list[bytes], lengths: list[list[int]], shard: int, number: int) -> Iterator[dict]:
    """A slice's nodes, those on its first or last path as parts, and its two ends.
    It counts as if it had no neighbours."""
    ids, turns, text, sizes, order = matrices(ids, own, lengths)
    n, width = turns.shape
    first, last = int(order[0]), int(order[-1])
    first_keys, last_keys = prefix_keys(own[first]), prefix_keys(own[last])
    # suffix[r, k]: code points of the texts of row r from column k on
    suffix = np.zeros((n, width + 1), np.int64)
    suffix[:, :width] = np.cumsum(text[:, ::-1], axis=1)[:, ::-1]
    # marks[r, d]: row r does not continue the beginning of length d of the row before
    marks = np.zeros((n, width + 1), bool)
    marks[0] = True
    marks[1:, 1:] = np.logical_or.accumulate(turns[1:] != turns[:-1], axis=1)
    shared = width + 1 - marks.sum(1)  # depths below this go on from the row before
    leaf = np.ones(n, np.int64)
    leaf[:-1] = shared[1:] <= sizes[:-1]  # else the next row begins with this whole row
    above = np.zeros(n, np.int64)  # of each row's node at the depth before: smallest member,
    where = np.zeros(n, np.int8)  # and whether it is whole (0), on the first (1) or the last (2) path
    for d in range(width + 1):
        inside = np.flatnonzero(sizes >= d)
        start = np.flatnonzero(marks[inside, d])
        top, size = inside[start], np.diff(np.r_[start, len(inside)])
        least = np.minimum.reduceat(ids[inside], start)
        children = (sizes[inside] > d) & marks[inside, d + 1] if d < width else np.zeros(len(inside), bool)
        # texts from depth d on, once less for the nodes that start here
        own_text = max(d - 1, 0)
        saved = suffix[inside, own_text] - suffix[inside, np.maximum(own_text, shared[inside] - 1)]
        per_node = [np.add.reduceat(x.astype(np.int64), start)
                    for x in (children, leaf[inside], saved, sizes[inside] == d)]
        place = np.where(top == 0, 1, np.where(top + size == n, 2, 0))
        for k, (r, at, c, m, ch, lv, sv, e) in enumerate(zip(*(x.tolist() for x in (top, place, least, size, *per_node)))):
            row = {"conv_id": c, "depth": d, "n_convs": m, "n_children": ch, "n_leaves": lv, "saved_tokens": sv}
            ends = pieces(ids[r:r + e])  # the shortest rows of a node come first
            if at:
                keys = first_keys if at == 1 else last_keys
                yield row | {"kind": PART, "key": keys[d], "parent_key": keys[d - 1] if d else None}
                for f, piece in ends:
                    yield {"kind": END, "key": keys[d], "first_end": f, "ends": piece}
                continue
            row |= {"kind": WHOLE, "ends": hashlib.sha256(b",".join(p for _, p in ends)).hexdigest().encode()}
            if where[r]:
                yield row | {"parent_key": (first_keys if where[r] == 1 else last_keys)[d - 1]}
            else:
                yield row | {"parent_conv_id": int(above[r])}
        above[inside], where[inside] = np.repeat(least, size), np.repeat(place, size)
    pack = lambda k: np.array(lengths[k], "<i8").tobytes()
    yield {"kind": EDGE, "shard": shard, "slice": number, "first": own[first], "first_lengths": pack(first),
           "last": own[last], "last_lengths": pack(last)}


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _nodes(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        rows = (row for k, part in enumerate(slices(batches, cells)) for row in slice_nodes(*part, shard, k))
        yield from batches_of(rows, arrow_schema(PARTS))
    return run


def correction(last: bytes, first: bytes, lengths: np.ndarray) -> Iterator[dict]:
    """What two neighbouring slices counted twice or wrongly, for the nodes on the
    beginning that the first one's last path and the next one's first path share."""
    n = min(len(last), len(first))
    a, b = (np.frombuffer(x[:n], "V16") for x in (last, first))
    differ = np.flatnonzero(a != b)
    common = int(differ[0]) if len(differ) else n // DIGEST
    keys = prefix_keys(first[:common * DIGEST])
    total = np.r_[0, np.cumsum(lengths[:common])]
    no_leaf = common * DIGEST == len(last)
    for d in range(common + 1):
        yield {"kind": PART, "key": keys[d], "parent_key": keys[d - 1] if d else None, "depth": d, "n_convs": 0,
               "n_children": -1 if d < common else 0, "n_leaves": -1 if no_leaf else 0,
               "saved_tokens": int(total[common] - total[max(d - 1, 0)])}


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for k in range(batch.num_rows)
            for last, first, lengths in [[c[k].as_py() for c in batch.columns]]
            for row in correction(last, first, np.frombuffer(lengths, "<i8")))
    yield from batches_of(rows, arrow_schema(PARTS))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; one piece is held at once."""
    def rows() -> Iterator[dict]:
        key, held = None, None
        for batch in batches:
            for own, piece in zip(batch.column(0), batch.column(1)):
                own, piece = own.as_py(), piece.as_py()
                if own != key:
                    if held is not None:
                        yield {"key": key, "hash": held.hexdigest()}
                    key, held = own, hashlib.sha256(piece)
                else:
                    held.update(b"," + piece)
        if held is not None:
            yield {"key": key, "hash": held.hexdigest()}
    yield from batches_of(rows(), arrow_schema("key binary, hash string"))


def trie(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie, columns ``COLUMNS``."""
    spark = turns.sparkSession
    folder, shards = shared_dir(spark), partitions(spark)
    rows = written(paths(turns), folder, "paths")
    parts = written(rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
                    .select("conv_id", "path", "lengths").mapInArrow(_nodes(cells), PARTS), folder, "parts")
    # slices in a row: their number in the shard after those of the shards before,
    # whose counts (one row for each shard) go to the driver
    edges = parts.where(F.col("kind") == EDGE)
    counts = sorted(edges.groupBy("shard").count().collect())
    before = np.r_[0, np.cumsum([c for _, c in counts])].tolist()
    offsets = spark.createDataFrame([(s, b) for (s, _), b in zip(counts, before)], "shard int, before bigint")
    edges = edges.join(F.broadcast(offsets), "shard").withColumn("at", F.col("before") + F.col("slice"))
    pairs = (edges.select((F.col("at") + 1).alias("at"), "last")
             .join(edges.select("at", "first", "first_lengths"), "at").select("last", "first", "first_lengths"))
    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = (parts.where(F.col("kind") == PART).unionByName(pairs.mapInArrow(_corrections, PARTS))
              .groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
                                  F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in numbers]))
    hashed = (parts.where(F.col("kind") == END).select("key", "ends", "first_end").repartition(shards, "key")
              .sortWithinPartitions("key", "first_end").mapInArrow(_hashes, "key binary, hash string"))
    shared = written(shared.join(hashed, "key", "left").withColumn(
        "ends_sha256", F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256))).drop("hash"), folder, "shared")
    whole = parts.where(F.col("kind") == WHOLE).withColumn("ends_sha256", F.col("ends").cast("string"))
    below = whole.where(F.col("parent_key").isNotNull()).select("parent_key", *[c for c in COLUMNS if c != "parent_conv_id"]) \
        .unionByName(shared.where(F.col("depth") > 0).drop("key"))
    per_key = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"),
                            F.col("n_children").alias("weight"))
    found = attach(below, per_key, "parent_key", "weight", below.count())
    root = shared.where(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return (whole.where(F.col("parent_key").isNull()).select(COLUMNS).unionByName(found.select(COLUMNS))
            .unionByName(root.select(COLUMNS)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The members of every node are listed, and each pair of a node and a node above it.
ORACLE_SQL = """
WITH bytes AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
turns AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c.conv_id, c.own, b.own AS base, (4294967295 - list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) % 6 AS h
  FROM turns c CROSS JOIN bytes LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 100),
built AS (SELECT conv_id, list_concat(coalesce(base[1:h], []), coalesce(own[h + 1:], [])) AS p FROM heads),
steps AS (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM built),
nodes AS (SELECT p[1:d] AS q, d, min(conv_id) AS conv_id, count(*) AS n,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(p) = d) AS ends
  FROM steps GROUP BY ALL),
linked AS (SELECT a.q, a.d, a.conv_id, a.n, a.ends, up.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes k WHERE k.d = a.d + 1 AND k.q[1:a.d] = a.q) AS n_children
  FROM nodes a LEFT JOIN nodes up ON a.d > 0 AND up.d = a.d - 1 AND up.q = a.q[1:a.d - 1]),
under AS (SELECT q[1:k] AS top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(q[d].text) END) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM linked) GROUP BY 1)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, CAST(n AS BIGINT) AS n_convs,
  CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ends, '')) AS ends_sha256
FROM linked JOIN under ON under.top = linked.q"""
