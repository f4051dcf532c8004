"""Packing (2): non-negative least squares over shallow length combinations.

Every document becomes its ids and the end id 0. Its whole windows are sequences
of their own; what is left, its tail, is 0 to ``window - 1`` ids long. The
histogram of tail lengths (``window`` numbers, whatever the input) goes to the
driver, where combinations of two or three lengths that fill a window exactly
are enumerated and their repeat counts found by non-negative least squares
against the histogram. The counts are rounded down, further combinations are
taken greedily while the remaining tails allow it, and the residual tails, by
falling length, are laid end to end and cut at the windows. So at most the last
sequence of all has padding, and only residual tails are cut.

No task orders all tails of a length: documents are dealt to buckets by a hash of
their row's number (so also a row that is repeated very often), ranked within
(bucket, length), and a bucket's ranks follow those of the buckets before it. From its length and rank each tail's place follows by formula, with
the table of combinations (bounded by the window) at hand.

Defined results
* null and empty texts hold the end id alone.
* Repeated rows, and rows of one id, are packed each for itself. Null ids are
  carried like others.
* An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir, text_slices, written
from .tokens import encoder

WINDOW = 1024
END_ID = 0
#: The smallest part of a combination of three is a multiple of this share of a window.
STEPS = 32
SWEEPS = 30
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def combinations(window: int) -> np.ndarray:
    """Rows of three ascending lengths that fill the window; 0 for none."""
    pairs = [(0, a, window - a) for a in range(1, window // 2 + 1)]
    step = max(1, window // STEPS)
    triples = [(a, b, window - a - b) for a in range(step, window // 3 + 1, step)
               for b in range(a, (window - a) // 2 + 1)]
    return np.array(pairs + triples, np.int64).reshape(-1, 3)


def least_squares(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' lengths near the histogram
    (sum of squares), by cyclic coordinate descent from zero."""
    x = np.zeros(len(combos))
    rest = histogram.astype(float).tolist()
    rest[0] = 0.0
    norms = [sum(c * c for c in np.unique(row[row > 0], return_counts=True)[1].tolist()) for row in combos]
    parts = [[p for p in row if p] for row in combos.tolist()]
    active = range(len(combos))
    for _ in range(SWEEPS):
        moved = 0.0
        for j in active:
            own = parts[j]
            change = max(-x[j], sum(rest[p] for p in own) / norms[j])
            if change:
                x[j] += change
                for p in own:
                    rest[p] -= change
                moved = max(moved, abs(change))
        if moved < 0.25:
            break
    return x


@dataclass
class Plan:
    """Where tails go. Tails of length L and rank r below ``taken[L]`` lie in the
    combination whose ``first`` is the last at or below L * scale + r; others are
    in the residual stream at ``base[L] + (r - taken[L]) * L``."""
    window: int
    scale: int
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    taken: np.ndarray
    base: np.ndarray
    combined: int


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    combos = combinations(window)
    x = least_squares(combos, histogram)
    left = histogram.astype(np.int64).tolist()
    left[0] = 0
    taken = [0] * window
    rows, used = [], 0

    def take(row: list[int], most: int) -> None:
        nonlocal used
        own = [p for p in row if p]
        n = min([most] + [left[p] // own.count(p) for p in own])
        if n <= 0:
            return
        offset = 0
        for p in sorted(own, reverse=True):
            rows.append((p, taken[p], used, offset))
            taken[p] += n
            left[p] -= n
            offset += p
        used += n

    listed = combos.tolist()
    for j in np.argsort(-x, kind="stable"):
        take(listed[j], int(x[j] + 1e-9))
    for row in listed:
        take(row, max(left))
    scale = int(histogram.max(initial=0)) + 1
    rows.sort()
    base, at = np.zeros(window, np.int64), 0
    for p in range(window - 1, 0, -1):
        base[p] = at
        at += left[p] * p
    return Plan(window, scale, np.array([p * scale + r for p, r, _, _ in rows], np.int64),
                np.array([[r, s] for _, r, s, _ in rows], np.int64).reshape(-1, 2),
                np.array([o for *_, o in rows], np.int64), np.array(taken, np.int64), base, used)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, window: int, folder: str) -> DataFrame:
    """Written, for each document: its number of ids, the crc32 of each whole
    window, its tail's length, crc32 and ids, and a number of its own (row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(vocabulary), np.array([end_id], np.uint32)
        for part, texts in text_slices(batches, as_text=True):
            rows = []
            for own in known.encode(texts):
                ids = np.append(np.frombuffer(own, "<u4"), end)
                whole = len(ids) // window
                tail = ids[whole * window:]
                kind = "<u2" if tail.max(initial=0) < 1 << 16 else "<u4"
                rows.append((len(ids), [_crc(ids[k * window:(k + 1) * window]) for k in range(whole)],
                             len(tail), _crc(tail), tail.astype(kind).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()),
                     *[pa.array(c, t) for c, t in zip(zip(*rows), (
                         pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()))]],
                    ["doc_id", "doc_tokens", "crcs", "tail_length", "tail_crc", "tail"])

    schema = "doc_id bigint, doc_tokens bigint, crcs array<bigint>, tail_length int, tail_crc bigint, tail binary"
    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), folder, "tokens")


def ranked(tokens: DataFrame, buckets: int) -> DataFrame:
    """``tokens`` with ``rank``, unique and gapless among tails of one length, and
    ``windows_before``, the number of whole windows of the documents before."""
    rows = tokens.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = rows.groupBy("bucket", "tail_length").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("w"))
    earlier = Window.partitionBy("tail_length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
              .groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("tail_length", "before"))).alias("before"),
                                     F.sum("w").alias("w")))
    # a row for each bucket: as few as there are partitions
    of_all = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("w", F.coalesce(F.sum("w").over(of_all), F.lit(0)))
    order = ["tail_length", "row"]
    in_bucket = Window.partitionBy("bucket").orderBy(*order)
    in_length = Window.partitionBy("bucket", "tail_length").orderBy(*order[1:])
    rows = (rows.withColumn("w_own", F.coalesce(F.sum(F.size("crcs")).over(
                in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("r_own", F.row_number().over(in_length) - 1))
    return rows.join(before, "bucket").select(
        *tokens.columns, (F.col("r_own") + F.col("before")[F.col("tail_length")]).alias("rank"),
        (F.col("w_own") + F.col("w")).alias("windows_before"))


def _placer(plan: Plan, n_windows: int):
    def place(length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, length, sequence, offset) of a tail's pieces."""
        if rank < plan.taken[length]:
            k = int(np.searchsorted(plan.first, length * plan.scale + rank, side="right")) - 1
            first_rank, first_sequence = plan.sequence[k].tolist()
            return [(0, length, n_windows + first_sequence + rank - first_rank, int(plan.offset[k]))]
        at = int(plan.base[length]) + (rank - int(plan.taken[length])) * length
        sequence, offset = divmod(at, plan.window)
        cut = min(length, plan.window - offset)
        first = n_windows + plan.combined + sequence
        return [(0, cut, first, offset)] + ([(cut, length - cut, first + 1, 0)] if cut < length else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                doc, n, length = row["doc_id"], row["doc_tokens"], row["tail_length"]
                for k, crc in enumerate(row["crcs"]):
                    out.append((doc, k * plan.window, plan.window, crc, n, row["windows_before"] + k, 0))
                if not length:
                    continue
                pieces = place(length, row["rank"])
                if len(pieces) == 1:
                    crcs = [row["tail_crc"]]
                else:
                    ids = np.frombuffer(row["tail"], f"<u{len(row['tail']) // length}")
                    crcs = [_crc(ids[a:a + m]) for a, m, _, _ in pieces]
                for (a, m, sequence, offset), crc in zip(pieces, crcs):
                    out.append((doc, n - length + a, m, crc, n, sequence, offset))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID,
         window: int = WINDOW) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    spark = docs.sparkSession
    tokens = tokenized(docs, vocabulary, end_id, window, shared_dir(spark))
    rows = tokens.groupBy("tail_length").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("w")).collect()
    histogram = np.zeros(window, np.int64)
    for r in rows:  # at most ``window`` rows
        histogram[r["tail_length"]] = r["n"]
    plan = make_plan(histogram, window)
    return ranked(tokens, partitions(spark)).mapInArrow(_placer(plan, sum(r["w"] for r in rows)), PIECES)


def op2_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
