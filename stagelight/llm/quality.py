"""Quality classifier (5): compression against dictionaries of good and bad text.

Two Zstandard dictionaries are built from pieces of good and of bad labelled
texts. A text is cut into pieces of the same size, each is compressed with either
dictionary, and the difference of the two total sizes over their sum (how much
better the good dictionary knows the text) becomes a probability by logistic
calibration on other labelled rows. Every piece of every text is read.

At most ``TRAIN_ROWS`` labelled rows (those with the smallest id hash) are used, a
documented bound on the classifier's sample: half give all their pieces for the
dictionaries, the other half calibrate. The pieces are dealt to ``PARTS`` tasks,
which choose a dictionary's content each, and the dictionaries are built from what
these chose. They have ``DICTIONARY_BYTES`` each and are broadcast.

Defined results
* null and empty texts have difference 0 and so the score of no evidence.
* Labels that are null, or of ids without a document, are not learnt from.
  Repeated documents are scored as often as they occur. Null ids count as held
  out or not by empty text.
* Without labelled rows of both kinds every score is the share of good ones, or
  0.5 without any. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, shared_dir, text_slices, written
from .toxicity import training_rows

TRAIN_ROWS = 12_000
PARTS = 24
PIECE = 384
DICTIONARY_BYTES = 256 << 10
LEVEL = 3
THRESHOLD = 0.7


def cut(text: bytes) -> list[bytes]:
    return [text[k:k + PIECE] for k in range(0, len(text), PIECE)]


def dictionary(pieces: list[bytes]) -> bytes:
    """Content of a dictionary for such pieces; few or tiny ones are used as they are."""
    if sum(map(len, pieces)) > 4 * PIECE and len(pieces) >= 20:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
        except zstandard.ZstdError:
            pass  # the library refuses samples that have nothing in common
    return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def sizer(content: bytes) -> Callable[[bytes], int]:
    """The size of a text's pieces, compressed with a dictionary each for itself."""
    held = None
    if content:
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False).compress
    return lambda text: sum(len(compress(piece)) for piece in cut(text))


def difference(text: bytes, good: Callable[[bytes], int], bad: Callable[[bytes], int]) -> float:
    """How much smaller the good dictionary makes a text, from -1 to 1."""
    if not text:
        return 0.0
    g, b = good(text), bad(text)
    return (b - g) / (b + g)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from x to P(y = 1), by Newton steps
    with a little shrinkage."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return 0.0, math.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))
    scale = float(x.std()) or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
    return float(w[0] / scale), float(w[1])


def _differences(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = (sizer(content) for content in shared.value)
        for part, texts in text_slices(batches):
            first = part.column(0)
            yield pa.RecordBatch.from_arrays(
                [first, pa.array([difference(t, good, bad) for t in texts], pa.float64())], ["key", "x"])
    return run


def _chosen(table: pa.Table) -> pa.Table:
    """For each label of a part, the pieces of its texts, or where they are more
    than a dictionary holds, those of a dictionary built from them."""
    texts: dict[int, list[tuple]] = {}
    for row in table.select(["label", "doc_id", "text"]).to_pylist():
        texts.setdefault(row["label"], []).append((row["doc_id"], row["text"]))
    out = {}
    for label, own in sorted(texts.items()):
        pieces = [piece for _, text in sorted(own) for piece in cut(text)]
        out[label] = pieces if sum(map(len, pieces)) <= DICTIONARY_BYTES else cut(dictionary(pieces))
    return pa.table({"part": pa.array([table["part"][0].as_py()] * len(out), pa.int32()),
                     "label": pa.array(list(out), pa.int32()),
                     "pieces": pa.array(list(out.values()), pa.list_(pa.binary()))})


def train(rows: DataFrame, folder: str) -> tuple[bytes, bytes, float, float]:
    """The two dictionaries, and slope and intercept of the calibration, from
    (doc_id, text, label)."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))), folder, "sample")
    learnt = rows.where("half = 0")
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(PARTS)).cast("int")
    chosen = (learnt.select("doc_id", "label", F.coalesce("text", F.lit("")).cast("binary").alias("text")).distinct()
              .withColumn("part", part).groupBy("part")
              .applyInArrow(_chosen, "part int, label int, pieces array<binary>")
              .orderBy("part").collect())  # about the content of PARTS dictionaries of each label at most
    contents = [dictionary([bytes(x) for r in chosen if r["label"] == k for x in r["pieces"]]) for k in (1, 0)]
    shared = spark.sparkContext.broadcast(contents)
    seen = rows.where("half = 1").select("label", "text").mapInArrow(_differences(shared), "key int, x double").collect()
    labels = [r["key"] for r in seen]
    if not all(contents):  # one kind of label alone says nothing about the other
        labels = labels + [r["label"] for r in learnt.select("label").collect()]
        return b"", b"", *calibrate(np.zeros(len(labels)), np.array(labels, float))
    return *contents, *calibrate(np.array([r["x"] for r in seen]), np.array(labels, float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    good, bad, slope, intercept = train(training_rows(docs, labels, "quality", TRAIN_ROWS), shared_dir(spark))
    shared = spark.sparkContext.broadcast((good, bad))
    found = docs.select("doc_id", "text").mapInArrow(_differences(shared), "key bigint, x double")
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("x") + F.lit(intercept))))
    return found.select(F.col("key").alias("doc_id"), (crc_mod(F.col("key"), 4) == 2).alias("held_out"),
                        score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
