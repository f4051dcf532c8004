"""Helpers shared by the operators: the shared folder, written intermediate
tables, text batches, and a join that stays balanced under hot keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 8 << 20
#: Spark then removes the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that Spark sends a Python task at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: Of intermediate tables, whose rows may be megabytes: pages end by size after any
#: row, and a codec that streams. Snappy keeps buffers as large as the largest page,
#: outside the heap, for as long as the executor lives.
PARQUET = {"compression": "zstd", "parquet.page.size.row.check.min": "1"}
#: What a Python worker gives up when it turns from token ids to other work.
GIVE_UP: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, as in tests
    on a local master, a temporary folder is made, set, and removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stagelight-llm-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the tasks this package, once for each application, as
    ``spark-submit --py-files`` would; the workers need not find it themselves."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="stagelight-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(spark.sparkContext.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand Python tasks ``BATCH_BYTES`` at once, rather than 64 MB, where
    the cluster has not set it: each task holds a batch on either side, and a worker
    what it derives from a batch."""
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``folder`` and read again: later steps
    neither recompute it nor depend on the executors that made it."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").options(**PARQUET).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path and the path in it, for binary files."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        path = "file://" + path
    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs, inner


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is, null as empty. Texts of ASCII
    alone (as many bytes as characters) take the quicker built-in."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, A_TO_Z, A_TO_Z.lower())))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark removes the shuffle files of each query that has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def give_back() -> None:
    """Returns freed memory to the system: Python workers stay alive between
    tasks, beside the executor's other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES,
                column: str = "text", as_text: bool = False) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Record batches cut so that each holds about ``size`` bytes of text at most
    (or one row), with the texts as UTF-8 bytes, or as strings; null is empty."""
    if not as_text:
        for give_up in GIVE_UP:
            give_up()
        give_back()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = [n or 0 for n in pc.binary_length(texts).to_pylist()]
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield _cut(batch, column, at, i, as_text)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield _cut(batch, column, at, batch.num_rows, as_text)
    give_back()


def _cut(batch: pa.RecordBatch, column: str, at: int, to: int, as_text: bool) -> tuple[pa.RecordBatch, list]:
    part = batch.slice(at, to - at)
    texts = part.column(part.schema.get_field_index(column))
    if as_text:
        return part, [t or "" for t in texts.to_pylist()]
    texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    return part, [t or b"" for t in texts.to_pylist()]


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with large binary columns, one in Python's memory at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
    give_back()


def attach(rows: DataFrame, per_key: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row for each key, ``weight`` its
    number of rows in ``rows``, ``total`` their sum), even if one key holds a
    third of the rows. A key is hot when it exceeds an equal share of the
    shuffle partitions; so at most that many keys are hot, which bounds what is
    broadcast, and their rows stay where they are. All others are shuffled.

    ``rows`` is read twice: give a written table. Null keys join nothing.
    """
    share = max(1, total // partitions(rows.sparkSession))
    hot = F.broadcast(per_key.where(F.col(weight) > share))
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(per_key.where(F.col(weight) > share).select(key)), key, "left_anti")
    return near.unionByName(far.join(per_key.where(F.col(weight) <= share), key))
