"""Benchmark decontamination (9): a distributed positional inverted index.

The training documents are indexed in shards of bounded size: each row of the
written index holds one shard's postings, (document, position) lists sorted by
term, for every term that the benchmark uses. A query window is answered in each
shard by intersecting its terms' lists, shifted by their offsets, from the
shard's rarest term on; most windows end at their first, empty list. With
``slop`` 0 that gives exact phrases, otherwise proximity matches: every term
within ``slop`` words of its place.

Benchmark items lie in the shared folder in blocks of about ``BLOCK_BYTES`` of
text, one block as a rule; a task holds one block at a time. So its memory is
bounded whatever the benchmark's size, and all items meet all documents.

Defined results
* Words are runs of letters a-z (after lower-casing A-Z), digits and characters
  beyond ASCII. A window is 13 consecutive words of an item, or the whole item if
  it has fewer, but not none.
* null and empty texts have no words: n_words 0, nothing hit, not contaminated.
* Every row of the documents gives one row, repeated rows too. Items of equal id
  count once; items with null id can hit words but are not listed.
* An empty benchmark hits nothing; an empty table of documents gives no rows.
* Only doc_id, text and item_id are read; other columns are ignored, or carried
  by ``clean_rows``, which keeps rows without an id.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, single_rows, text_slices, written

WINDOW = 13
BLOCK_BYTES = 4 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
INDEX_SCHEMA = ("shard string, block int, doc_ids array<bigint>, n_words array<int>, "
                "terms binary, counts binary, postings binary")
FOUND_SCHEMA = "shard string, at int, starts array<int>, ends array<int>, items array<bigint>"


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Queries:
    """The windows of one block of items, as term numbers."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.starts: list[int] = []      # of each window in ``sequence``
        self.lengths: list[int] = []
        self.owners: list[int] = []      # position in ``ids``
        sequence: list[int] = []
        for item_id, text in items:
            found = words(text)
            if not found:
                continue
            first = len(sequence)
            sequence.extend(self.terms.setdefault(w, len(self.terms)) for w in found)
            n = min(window, len(found))
            for k in range(len(found) - n + 1):
                self.starts.append(first + k)
                self.lengths.append(n)
                self.owners.append(len(self.ids))
            self.ids.append(item_id)
        self.sequence = np.array(sequence, np.int64)


def write_blocks(benchmark: DataFrame, folder: str, window: int = WINDOW) -> list[str]:
    """Writes the benchmark's windows in blocks; returns the blocks' paths."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    paths = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        block = Queries([(r["item_id"], bytes(r["text"])) for r in part.collect()], window)
        fs, path = filesystem(f"{folder}/blocks/{k}")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(pickle.dumps(block))
        paths.append(f"{folder}/blocks/{k}")
    return paths


_HELD: dict[str, Queries] = {}


def read_block(path: str) -> Queries:
    """A block; each worker holds the last it read."""
    if path not in _HELD:
        _HELD.clear()
        fs, inner = filesystem(path)
        with fs.open_input_stream(inner) as f:
            _HELD[path] = pickle.loads(f.read())
    return _HELD[path]


def _postings(found: list[list[bytes]], block: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the block that occur, their numbers of postings, and the postings
    by term, each term's in order of document and position."""
    get = block.terms.get
    keys, terms = [], []
    for at, text in enumerate(found):
        numbers = np.array([get(w, -1) for w in text], np.int32)
        here = np.flatnonzero(numbers >= 0)
        terms.append(numbers[here])
        keys.append(here | (at << 32))
    term, key = np.concatenate(terms), np.concatenate(keys)
    order = np.argsort(term, kind="stable")
    own, counts = np.unique(term[order], return_counts=True)
    return own, counts, key[order]


def build_index(docs: DataFrame, blocks: list[str], folder: str) -> DataFrame:
    """Writes the index of ``docs``: a row for each shard and block; the rows of
    the first block also list the shard's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            shard, found = uuid.uuid4().hex, [words(t) for t in texts]
            ids = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()).to_pylist()
            for k, path in enumerate(blocks):
                own, counts, keys = _postings(found, read_block(path))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([k], pa.int32()),
                     pa.array([ids if k == 0 else []], pa.list_(pa.int64())),
                     pa.array([[len(f) for f in found] if k == 0 else []], pa.list_(pa.int32())),
                     pa.array([own.astype("<i4").tobytes()]), pa.array([counts.astype("<i8").tobytes()]),
                     pa.array([keys.astype("<i8").tobytes()])],
                    ["shard", "block", "doc_ids", "n_words", "terms", "counts", "postings"])

    return written(docs.select("doc_id", "text").mapInArrow(run, INDEX_SCHEMA), folder, "index")


def intersect(lists: list[np.ndarray], offsets: list[int], slop: int = 0) -> np.ndarray:
    """Starts of the windows whose every term lies at its offset, or within
    ``slop`` of it. ``lists``: sorted keys (document << 32 | position), rarest first."""
    starts = lists[0] - offsets[0]
    if slop:  # any start that leaves the rarest term near its place, within its document
        moved = starts[:, None] + np.arange(-slop, slop + 1)
        starts = np.unique(np.maximum(moved, (lists[0] >> 32 << 32)[:, None]))
    for keys, offset in zip(lists[0 if slop else 1:], offsets[0 if slop else 1:]):
        if not len(starts):
            break
        low = starts + (offset - slop)
        at = np.searchsorted(keys, low)
        at[at == len(keys)] = len(keys) - 1
        starts = starts[(keys[at] >= low) & (keys[at] <= low + 2 * slop)]
    return starts


def shard_matches(row: dict, queries: Queries, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of the first word, number of words and owner of each match in a shard."""
    terms = np.frombuffer(row["terms"], "<i4")
    counts = np.frombuffer(row["counts"], "<i8")
    postings = np.frombuffer(row["postings"], "<i8")
    ends = np.cumsum(counts)
    size = np.zeros(len(queries.terms), np.int64)
    size[terms] = counts
    end = np.zeros(len(queries.terms), np.int64)
    end[terms] = ends
    size_at = size[queries.sequence]
    absent = np.concatenate(([0], np.cumsum(size_at == 0)))
    starts, lengths = np.array(queries.starts, np.int64), np.array(queries.lengths, np.int64)
    complete = np.flatnonzero(absent[starts + lengths] == absent[starts]) if len(starts) else []
    keys, spans, owners = [], [], []
    for w in complete:
        first, n = queries.starts[w], queries.lengths[w]
        rarest = np.argsort(size_at[first:first + n], kind="stable")
        lists = [postings[end[t] - size[t]:end[t]] for t in queries.sequence[first + rarest]]
        found = intersect(lists, rarest.tolist(), slop)
        if len(found):
            keys.append(found)
            spans.append(np.full(len(found), n))
            owners.append(np.full(len(found), queries.owners[w]))
    if not keys:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(keys), np.concatenate(spans), np.concatenate(owners)


def _searcher(blocks: list[str], slop: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            queries = read_block(blocks[row["block"]])
            keys, spans, owners = shard_matches(row, queries, slop)
            out = []
            order = np.argsort(keys >> 32, kind="stable")
            keys, spans, owners = keys[order], spans[order], owners[order]
            ats, first = np.unique(keys >> 32, return_index=True)
            for at, a, b in zip(ats, first, [*first[1:], len(keys)]):
                ranges = merged(keys[a:b] & 0xFFFFFFFF, spans[a:b])
                ids = {queries.ids[k] for k in np.unique(owners[a:b])} - {None}
                out.append((row["shard"], int(at), [x for x, _ in ranges], [y for _, y in ranges], sorted(ids)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())))],
                    ["shard", "at", "starts", "ends", "items"])
    return run


def merged(first: np.ndarray, spans: np.ndarray) -> list[tuple[int, int]]:
    """The union of [first, first + span) as ascending, separate ranges."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(first.tolist(), spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """For each document: doc_id, n_words, positions (of its hit words, distinct)
    and items (distinct ids of the items with an occurring window)."""
    folder = shared_dir(docs.sparkSession)
    blocks = write_blocks(benchmark, folder, window)
    index = build_index(docs, blocks, folder)
    rows = (index.where("block = 0")
            .select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "d"))
            .select("shard", "at", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words")))
    covered = F.transform(F.arrays_zip("starts", "ends"), lambda r: F.sequence(r["starts"], r["ends"] - 1))
    found = (index.select("shard", "block", "terms", "counts", "postings")
             .mapInArrow(_searcher(blocks, slop), FOUND_SCHEMA)
             .select("shard", "at", F.flatten(covered).alias("positions"), "items")
             .groupBy("shard", "at").agg(
                 F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"),
                 F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    empty_int, empty_long = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    return rows.join(found, ["shard", "at"], "left").select(
        "doc_id", "n_words", F.coalesce("positions", empty_int).alias("positions"),
        F.coalesce("items", empty_long).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.size("positions").cast("long")
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return search(docs, benchmark).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all their columns."""
    bad = decontaminate(docs, benchmark).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def op9_decontaminate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = """
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM lowered),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[k:k + least(len(w), 13) - 1] AS words
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, k, w[k:k + n - 1] AS words
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, lengths WHERE len(w) >= n)),
matches AS (SELECT g.doc_id, g.k, g.n, q.item_id FROM grams g JOIN windows q ON g.n = q.n AND g.words = q.words),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM matches) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM matches) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
