"""Token-ID output (3): Simple-8b word-aligned coding.

Every 64-bit word holds a 4-bit selector and as many equally wide ids as fit the
other 60 bits; the encoder takes the selector that packs most of the next ids.
Ids are coded in blocks of ``BLOCK`` that begin at a word of their own, so
readers seek by the table of block offsets and decode all words of a selector at
once.

File format (little-endian): the words of all blocks; the block table, the first
word of each block and the number of words, as unsigned 64-bit integers; the
documents' table, doc_id (signed 64-bit) and number of ids (unsigned 64-bit) of
each; then the footer: the number of ids, of blocks and of documents (unsigned
64-bit) and the magic ``SL8BIDS1``.

Selector 0 and 1 stand for 240 and 120 ids of value 0; 2 to 14 for 60, 30, 20,
15, 12, 10, 8, 7, 6, 5, 4, 3 and 2 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20
and 30 bits; 15 for one id of up to 60 bits. The escape for a larger id is a word
of selector 15 whose 60 bits are all ones, followed by the id as a whole word.

Documents are dealt by ranges of their id, each range is a file, and the files'
numbers follow the ids: read in order, they give all ids in ascending doc_id.

Defined results
* null text is empty; every document ends with the end id, so has one id at least.
* Rows of equal doc_id are separate documents in one file; they follow each other
  in order of their ids' crc32, so repeated rows change nothing. Rows with null
  doc_id come first and have start counted like all others.
* An empty table gives no file and no row. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, partitions, shared_dir, text_slices, written
from .tokens import encoder

BLOCK = 4096
MAGIC = b"SL8BIDS1"
#: Ids and bits of each selector; fixed by the format.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = np.uint64((15 << 60) | ((1 << 60) - 1))
_PAYLOAD = np.uint64((1 << 60) - 1)


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SHORT_BITS = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 61 for those that need an escape (the all-ones payload too)."""
    if ids.max() < 1 << 16:
        return _SHORT_BITS[ids]
    bits = np.searchsorted(_POWERS, ids, side="right").astype(np.uint8)
    bits[ids >= _PAYLOAD] = 61
    return bits


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each position of a row the selector that packs most of the ids from
    there on; 16 for an escape. Behind its end each row has 240 values of 255,
    so no word reaches beyond a block."""
    flat = bits.ravel()
    best = np.where(flat > 60, 16, 15).astype(np.uint8)
    widest = {1: flat}  # by count: the most bits among so many ids from each position on
    for s in range(14, -1, -1):  # rising counts: the last that fits stays
        count = COUNTS[s]
        base = max(k for k in widest if k < count)
        while 2 * base < count:
            widest[2 * base] = np.maximum(widest[base][:len(widest[base]) - base], widest[base][base:])
            base *= 2
        shift = count - base
        wide = np.maximum(widest[base][:len(widest[base]) - shift], widest[base][shift:])
        widest[count] = wide
        fits = wide <= WIDTHS[s]
        if not fits.any():
            break  # nor do more ids of fewer bits
        best[:len(wide)][fits] = s
    return best.reshape(bits.shape)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ids (unsigned integers) and the first word of each block."""
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    n_blocks = -(-n // BLOCK)
    bits = np.full((n_blocks, BLOCK + COUNTS[0]), 255, np.uint8)
    found = _bits(ids)
    whole = n // BLOCK
    bits[:whole, :BLOCK] = found[:whole * BLOCK].reshape(whole, BLOCK)
    if whole < n_blocks:
        bits[whole, :n - whole * BLOCK] = found[whole * BLOCK:]
    best = _selectors(bits)[:, :BLOCK].reshape(-1)[:n]
    step = np.array([*COUNTS, 1])[best]
    first = np.arange(0, n, BLOCK)
    is_start = np.zeros(n, bool)
    at, last = first, np.minimum(first + BLOCK, n)
    while len(at):  # all blocks advance together, a word each
        is_start[at] = True
        at = at + step[at]
        more = at < last
        if not more.all():
            at, last = at[more], last[more]
    start = np.flatnonzero(is_start)
    chosen = best[start]
    size = 1 + (chosen == 16)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        if s == 16:
            words[to[here]] = ESCAPE
            words[to[here] + 1] = ids[start[here]]
            continue
        word = np.full(len(here), int(s) << 60, np.uint64)
        if WIDTHS[s]:
            for k in range(COUNTS[s]):
                word |= ids[start[here] + k].astype(np.uint64) << np.uint64(k * WIDTHS[s])
        words[to[here]] = word
    return words, to[np.searchsorted(start, first)].astype(np.uint64)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of whole blocks' words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    escapes = np.flatnonzero(words == ESCAPE)
    if len(escapes):  # what follows an escape is an id; one may look like an escape itself
        taken, raw = -1, []
        for e in escapes.tolist():
            if e > taken:
                raw.append(e + 1)
                taken = e + 1
        raw = np.array(raw)
        selector[raw - 1] = 17
        selector[raw] = 16
    counts = np.array([*COUNTS, 1, 0])[selector]
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == 16:
            out[to[here]] = words[here]
        elif s < 16 and WIDTHS[s]:
            mask, own, place = np.uint64((1 << WIDTHS[s]) - 1), words[here], to[here]
            for k in range(COUNTS[s]):
                out[place + k] = (own >> np.uint64(k * WIDTHS[s])) & mask
    return out[:n]


class Writer:
    """A file of the format: documents are added in order, words are written as
    blocks fill, so memory holds a few blocks and the tables."""

    def __init__(self, out):
        self.out, self.words, self.n = out, 0, 0
        self.offsets: list[np.ndarray] = []
        self.docs: list[tuple[int, int]] = []
        self.held: list[np.ndarray] = []
        self.held_n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((np.iinfo(np.int64).min if doc_id is None else doc_id, len(ids)))
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= 256 * BLOCK:
            self._flush(self.held_n // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        words, offsets = encode(ids[:n])
        self.out.write(words.astype("<u8").tobytes())
        self.offsets.append(offsets + np.uint64(self.words))
        self.words += len(words)
        self.n += n
        self.held, self.held_n = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held_n)
        offsets = np.concatenate(self.offsets)
        self.out.write(np.append(offsets, np.uint64(self.words)).astype("<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").tobytes())
        self.out.write(np.array([self.n, len(offsets), len(self.docs)], "<u8").tobytes() + MAGIC)


class Reader:
    """Reads a file's tables, then ids by blocks."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        foot = self._read(size - 32, 32)
        if foot[24:] != MAGIC:
            raise ValueError("not a file of token ids")
        self.n, n_blocks, n_docs = np.frombuffer(foot[:24], "<u8").tolist()
        docs_at = size - 32 - 16 * n_docs
        self.docs = np.frombuffer(self._read(docs_at, 16 * n_docs), "<i8").reshape(-1, 2)
        self.offsets = np.frombuffer(self._read(docs_at - 8 * (n_blocks + 1), 8 * (n_blocks + 1)), "<u8").astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last, exclusive."""
        a, b = self.offsets[first], self.offsets[last]
        words = np.frombuffer(self._read(8 * a, 8 * (b - a)), "<u8")
        return decode(words, min(self.n, last * BLOCK) - first * BLOCK)

    def documents(self, at_once: int = 256) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each document, reading ``at_once`` blocks at a time."""
        held, block, n_blocks = np.empty(0, np.uint64), 0, len(self.offsets) - 1
        for doc_id, n in self.docs.tolist():
            parts, have = [held], len(held)
            while have < n:
                more = self.blocks(block, min(block + at_once, n_blocks))
                block = min(block + at_once, n_blocks)
                parts.append(more)
                have += len(more)
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (None if doc_id == np.iinfo(np.int64).min else doc_id), held[:n]
            held = held[n:]


def ranges(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with ``part``, the number of its range of doc_id, for about n ranges
    of equal size; the bounds come from all ids."""
    bounds = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))

    def place(a: int, z: int) -> Column:
        """Number of bounds below doc_id, known to be a to z, by halving."""
        if a == z:
            return F.lit(a)
        middle = (a + z) // 2
        return F.when(F.col("doc_id") <= bounds[middle], place(a, middle)).otherwise(place(middle + 1, z))

    return docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place(0, len(bounds))))


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, files: int) -> DataFrame:
    """Encodes and writes; returns the written list of files: part, path, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, opened = encoder(vocabulary), {}
        end = np.array([end_id], np.uint32)
        fs, base = filesystem(folder)
        fs.create_dir(f"{base}/ids", recursive=True)
        waiting: dict[int, list] = {}
        for part, texts in text_slices(batches, as_text=True):
            ids = known.encode(texts)
            numbers = part.column(part.schema.get_field_index("part")).to_pylist()
            for number, doc_id, own in zip(numbers, part.column(part.schema.get_field_index("doc_id")).to_pylist(), ids):
                if number not in opened:  # a name of its own for each attempt: what is listed is whole
                    name = f"ids/{number:08d}-{uuid.uuid4().hex}.s8b"
                    out = fs.open_output_stream(f"{base}/{name}")
                    opened[number] = (name, out, Writer(out))
                    waiting[number] = []
                tokens = np.append(np.frombuffer(own, "<u4"), end)
                same = waiting[number]
                if same and same[0][0] != doc_id:
                    _settle(opened[number][2], same)
                    same = waiting[number] = []
                same.append((doc_id, tokens))
        for number, (name, out, writer) in opened.items():
            _settle(writer, waiting[number])
            writer.close()
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(opened), pa.int32()), pa.array([x[0] for x in opened.values()], pa.string()),
             pa.array([x[2].n for x in opened.values()], pa.int64())], ["part", "path", "n_tokens"])

    dealt = (ranges(docs.select("doc_id", "text"), files).repartitionById(files, "part")
             .sortWithinPartitions("part", "doc_id"))
    return written(dealt.mapInArrow(run, "part int, path string, n_tokens bigint"), folder, "files")


def _settle(writer: Writer, same: list[tuple[int | None, np.ndarray]]) -> None:
    """Adds documents of one id, in the order of their ids' crc32."""
    for doc_id, tokens in sorted(same, key=lambda x: zlib.crc32(x[1].astype("<u4").tobytes())) if len(same) > 1 else same:
        writer.add(doc_id, tokens)


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Reads the files back; per document: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['path']}") as f:
                    start, out = row["start"], []
                    for doc_id, ids in Reader(f).documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each file: few, whatever the number of documents
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.withColumn("start", before)
    return (listed.repartition(max(1, partitions(files.sparkSession)), "part")
            .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2,
                folder: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` below ``folder`` and reads the files back."""
    folder = folder or shared_dir(docs.sparkSession)
    files = write_files(docs, folder, vocabulary, end_id, max(2, partitions(docs.sparkSession)))
    return read_files(files, folder)


def op3_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
