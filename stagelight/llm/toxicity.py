"""Toxicity (8): FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features of a text are the distinct hashes of its lower-cased words, its word
pairs and its pairs with one word between. FTRL-proximal gives every coordinate
its own learning rate, and its L1 term leaves most weights at exactly zero, so
the model is a short list of (slot, weight) that is safe to broadcast: at most
``2 ** BITS`` slots.

Training uses at most ``TRAIN_ROWS`` labelled rows (those with the smallest id
hash; a documented bound on the classifier's sample). Their features are dealt
to ``SHARDS`` tasks; in each round every shard continues from the common state,
and the shards' changes of a slot are averaged. Scoring reads every whole text.

Defined results
* null and empty texts have no feature: their score is the model's base rate.
* Labels that are null, or of ids without a document, are not learnt from; an id
  with several labels is learnt with each; a repeated document is scored as
  often as it occurs. Null ids count as held out or not by empty text.
* Without any labelled row every score is 0.5. An empty table gives no rows.
* Only doc_id and text are read; further columns are ignored, or carried by
  ``clean_rows``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, shared_dir, shuffles_removed, single_rows, text_slices, written

BITS = 20
TRAIN_ROWS = 24_000
SHARDS = 6
ROUNDS = 6
ALPHA, BETA, L1, L2 = 5.0, 1.0, 2.5, 0.1
#: The slots are merged in so many ranges, each by one task.
RANGES = 16
THRESHOLD = 0.3
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def features(text: bytes) -> np.ndarray:
    """Slots of a text's words, word pairs and skip-grams, with repeats."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    parts = [h]
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            x = (h[:-gap] * np.uint64(odd)) ^ (h[gap:] + np.uint64(gap))
            parts.append((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(parts) >> np.uint64(64 - BITS)


class Ftrl:
    """State of FTRL-proximal: z and n per slot; the last slot is the intercept."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(w.sum())))))
        g = p - label
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def _with_intercept(slots: np.ndarray) -> np.ndarray:
    return np.append(np.unique(slots).astype(np.int64), 1 << BITS)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches):
        out = [_with_intercept(features(t)).astype("<i4").tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("doc_id")),
             part.column(part.schema.get_field_index("label")).cast(pa.int32()),
             pa.array(out, pa.binary())], ["doc_id", "label", "slots"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled training documents: doc_id, text, label. The
    sample is those with the smallest id hash; its ids are bounded by ``limit``,
    so they are broadcast and the texts are not shuffled."""
    chosen = (labels.where((crc_mod(F.col("doc_id"), 4) != 2) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
              .select("doc_id", F.col(label).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


STATE_SCHEMA = "slots binary, z binary, n binary"


def _pack(table: pa.Table) -> pa.Table:
    """A shard's rows in one, in the order of id and label."""
    order = np.lexsort((table["label"].to_numpy(), table["doc_id"].to_numpy()))
    slots, label = table["slots"].to_pylist(), table["label"].to_numpy()[order]
    return pa.table({"labels": [label.astype("<i4").tobytes()], "slots": [b"".join([slots[i] for i in order])],
                     "sizes": [np.array([len(slots[i]) // 4 for i in order], "<i4").tobytes()]})


def _round(state: Broadcast, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round over each shard, from the common state, in a fixed random order."""
    size = (1 << BITS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            at, z0, n0 = state.value
            model = Ftrl(np.zeros(size), np.zeros(size))
            model.z[at], model.n[at] = z0, n0
            labels = np.frombuffer(row["labels"], "<i4")
            slots = np.split(np.frombuffer(row["slots"], "<i4"), np.cumsum(np.frombuffer(row["sizes"], "<i4"))[:-1])
            for i in np.random.default_rng(number).permutation(len(labels)):
                model.learn(slots[i], int(labels[i]))
            model.z[at] -= z0
            model.n[at] -= n0
            moved = np.flatnonzero(model.n)  # every slot that a row has met
            cut = np.searchsorted(moved, np.arange(RANGES + 1) * -(-size // RANGES))
            parts = [moved[a:b] for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(RANGES), pa.int32()), pa.array([p.astype("<i4").tobytes() for p in parts]),
                 pa.array([model.z[p].astype("<f4").tobytes() for p in parts]),
                 pa.array([model.n[p].astype("<f4").tobytes() for p in parts])], ["part", "slots", "z", "n"])

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The mean move of each slot of a range over the shards that met it."""
    slots, z, n = (np.frombuffer(b"".join(table[c].to_pylist()), kind)
                   for c, kind in (("slots", "<i4"), ("z", "<f4"), ("n", "<f4")))
    distinct, place, seen = np.unique(slots, return_inverse=True, return_counts=True)
    mean = lambda x: (np.bincount(place, x, len(distinct)) / seen).astype("<f4").tobytes()
    return pa.table({"slots": [distinct.astype("<i4").tobytes()], "z": [mean(z)], "n": [mean(n)]})


def train(rows: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Learns from (doc_id, text, label); returns the slots and their weights."""
    spark = rows.sparkSession
    shards = written(rows.mapInArrow(_feature_rows, "doc_id bigint, label int, slots binary")
                     .groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))).applyInArrow(
                         _pack, "labels binary, slots binary, sizes binary"), folder, "shards")
    size = (1 << BITS) + 1
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for number in range(ROUNDS):
        at = np.flatnonzero(n).astype(np.int32)
        state = spark.sparkContext.broadcast((at, z[at], n[at]))
        moves = shards.mapInArrow(_round(state, number), f"part int, {STATE_SCHEMA}")
        # a row for each range, together at most 2 ** BITS slots, whatever the input
        with shuffles_removed(spark):
            for s in moves.groupBy("part").applyInArrow(_merged, STATE_SCHEMA).collect():
                own = np.frombuffer(s["slots"], "<i4")
                z[own] += np.frombuffer(s["z"], "<f4")
                n[own] += np.frombuffer(s["n"], "<f4")
        state.destroy()
    w = Ftrl(z, n).weights(np.arange(size))
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32)


def _scorer(model: Broadcast) -> Callable[[list[bytes]], list[float]]:
    at, w = model.value
    table = np.zeros((1 << BITS) + 1, np.float32)
    table[at] = w
    base = float(table[-1])

    def scores(texts: list[bytes]) -> list[float]:
        out = []
        for t in texts:
            slots = features(t).astype(np.int64)
            slots = np.unique(slots[table[slots] != 0])
            x = base + float(table[slots].sum(dtype=np.float64))
            out.append(1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, x)))))
        return out

    return scores


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared)
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(scores(texts), pa.float64())],
                ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below THRESHOLD, all their columns."""
    folder = shared_dir(docs.sparkSession)
    model = train(training_rows(docs, labels, "toxic", TRAIN_ROWS), folder)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared)
        for part, texts in text_slices(batches):
            yield part.filter(pa.array([s < THRESHOLD for s in scores(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each document: doc_id, held_out, score, predicted."""
    folder = shared_dir(docs.sparkSession)
    model = train(training_rows(docs, labels, "toxic", TRAIN_ROWS), folder)
    return score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
