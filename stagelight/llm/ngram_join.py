"""N-gram Jaccard join (6): a blocked sparse matrix product of the document by
n-gram incidence.

Documents are rows, their distinct 5-word shingles (as 64-bit hashes) columns.
Two documents link when 100 * intersection >= 75 * union. Everything is exact;
what keeps the product small loses no link:

1. Documents of equal sets are one row of the matrix, a class.
2. A class of n shingles whose partner lacks more than ``n - ceil(0.75 n)`` of
   them has no link. Of every set the columns below a fixed hash bound are dealt
   to buckets, which find the columns of two classes or more. A class that has
   more unshared columns there than it may lack is done: it has no link.
3. Of the others only as many of their smallest shared columns are used as must
   include one that a partner has (prefix filter over a common order). A class
   with too few columns below the bound uses the smallest of its whole set.
4. Each column's classes first meet the one among them most of whose columns are
   shared; verified overlaps link, and classes that link to the same one need
   not meet again.
5. What remains: pairs accumulate the number of columns of step 3 that they have
   in common, and those below the bound that their sizes demand are dropped.
   Short columns give their pairs one by one. The classes of long columns are cut
   into blocks, and each pair of blocks that shares a column is one product, first
   over the columns of step 3, then, for what passes the bound, over whole sets.
   Only edges that join components leave it. Blocks lie in the shared folder.

So a group of N near copies costs N pairs rather than their square. No pair table
holds equal texts or a whole group.

Defined results
* Texts without words (null, empty) have no shingle, link with nothing and are
  their own component. A text of fewer than five words is one shingle.
* Rows of one id with equal sets are one document (returned once); with different
  sets each is returned, and each takes part. A null doc_id gives n_shingles, has
  component_id null and links with nothing.
* An empty table gives an empty result. Other columns are ignored by ``join``,
  and carried by ``one_of_each``, which keeps the smallest doc_id of a component
  (and rows without id).
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, filesystem, partitions, shared_dir, text_slices, written
from .components import components

SHINGLE = 5
#: Link when PER_CENT * union <= 100 * intersection.
PER_CENT = 75
#: Columns with a hash below this share of all are counted in step 2.
COUNTED = 0.35
BOUND = np.uint64(int(COUNTED * 2 ** 64))
#: Columns of more classes than this are multiplied in blocks.
SHORT = 32
BLOCK_ROWS = 256
BLOCK_ENTRIES = 400_000
SLICE = 4096

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: bytes) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = text.lower().split()  # bytes: A-Z, and white space \x20 \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    x = h[:n] * _ODD[0]
    for k in range(1, SHINGLE):
        x = (x ^ (x >> np.uint64(29))) * _ODD[1] + h[k:k + n]
    x = (x ^ (x >> np.uint64(32))) * _ODD[2]
    return np.unique(x ^ (x >> np.uint64(29)))


def class_of(found: np.ndarray) -> int:
    """A set's class: the hash of its hashes. With n it names the set."""
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0


def may_lack(n):
    """How many shingles of a set of n a partner may lack."""
    return n - -(-PER_CENT * n // 100)


MAPPED = "bucket int, kind int, hashes binary, classes binary, sizes binary, counted binary, ids binary"
COUNTS = "kind int, doc_id bigint, cls bigint, n int, counted int, h bigint"
#: Kinds of rows: the columns of classes, asked about; columns known to be shared;
#: columns of a class with few counted ones; documents.
ASK, SHARED, WHOLE, DOCUMENT = range(4)
NO_ID = np.iinfo(np.int64).min


def _incidence(buckets: int):
    def rows(kind: int, bucket: np.ndarray, **columns: np.ndarray) -> Iterator[tuple]:
        """A row for each bucket; ``bucket`` ascends."""
        own, first = np.unique(bucket, return_index=True)
        for b, a, z in zip(own.tolist(), first, [*first[1:], len(bucket)]):
            yield (b, kind, *(columns[c][a:z].tobytes() if c in columns else b""
                              for c in ("hashes", "classes", "sizes", "counted", "ids")))

    def slice_rows(ids: list[int | None], texts: list[bytes], own_bucket: int) -> Iterator[tuple]:
        """``own_bucket``: where what is only passed on goes, whatever the texts are."""
        sets, documents = {}, []
        for doc_id, text in zip(ids, texts):
            found = shingles(text)
            cls, n = class_of(found), len(found)
            documents.append((NO_ID if doc_id is None else doc_id, cls, n))
            if n and doc_id is not None:
                sets.setdefault((cls, n), found)
        d = np.array(documents, np.int64)
        yield from rows(DOCUMENT, np.full(len(d), own_bucket), ids=d[:, 0], classes=d[:, 1],
                        sizes=d[:, 2].astype(np.int32))
        if not sets:
            return
        own = list(sets.values())
        classes = np.array([c for c, _ in sets], np.int64)
        sizes = np.array([n for _, n in sets], np.int32)
        counted = np.array([np.searchsorted(s, BOUND) for s in own], np.int32)
        few = counted <= may_lack(sizes.astype(np.int64))
        whole = [s[:may_lack(len(s)) + 1] for s, f in zip(own, few) if f]
        if whole:
            lengths = [len(w) for w in whole]
            yield from rows(WHOLE, np.full(sum(lengths), own_bucket), hashes=np.concatenate(whole),
                            classes=np.repeat(classes[few], lengths), sizes=np.repeat(sizes[few], lengths),
                            counted=np.repeat(counted[few], lengths))
        h = np.concatenate([s[:k] for s, k in zip(own, counted)])
        owner = np.repeat(np.arange(len(own)), counted)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        same = np.concatenate(([False], h[1:] == h[:-1]))
        repeated = same | np.concatenate((same[1:], [False]))
        known = np.flatnonzero(repeated)  # of two classes in this slice: shared, no question
        if len(known):
            o = owner[known]
            by = np.argsort(o, kind="stable")
            known, o = known[by], o[by]
            yield from rows(SHARED, np.full(len(known), own_bucket), hashes=h[known],
                            classes=classes[o], sizes=sizes[o], counted=counted[o])
        ask = np.flatnonzero(~same)  # each column once; of a repeated one only that it is shared
        o = owner[ask]
        bucket = (h[ask] >> np.uint64(32)) * np.uint64(buckets) // np.uint64(int(BOUND) >> 32)
        yield from rows(ASK, np.minimum(bucket, np.uint64(buckets - 1)).astype(np.int32), hashes=h[ask],
                        classes=classes[o], sizes=np.where(repeated[ask], 0, sizes[o]).astype(np.int32),
                        counted=counted[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        task = TaskContext.get().partitionId()  # the same in all attempts
        for k, (part, texts) in enumerate(text_slices(batches)):
            ids = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()).to_pylist()
            out = list(slice_rows(ids, texts, xxhash.xxh64_intdigest(f"{task}/{k}") % buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)],
                ["bucket", "kind", "hashes", "classes", "sizes", "counted", "ids"])
    return run


def _read(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    part = table.filter(pc.equal(table["kind"], kind))
    return {c: np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (
        ("hashes", "<u8"), ("classes", "<i8"), ("sizes", "<i4"), ("counted", "<i4"), ("ids", "<i8"))}


def _count(table: pa.Table) -> pa.Table:
    """A bucket's answers: its columns that two classes or more have, and what it
    was given to pass on."""
    def rows(kind, hashes=None, classes=None, sizes=None, counted=None, ids=None):
        n = len(classes)
        return pa.table({"kind": np.full(n, kind, np.int32),
                         "doc_id": pa.nulls(n, pa.int64()) if ids is None else pa.array(ids, mask=ids == NO_ID),
                         "cls": classes, "n": sizes.astype(np.int32),
                         "counted": pa.nulls(n, pa.int32()) if counted is None else pa.array(counted, pa.int32()),
                         "h": pa.nulls(n, pa.int64()) if hashes is None else hashes.view(np.int64)})

    a = _read(table, ASK)
    order = np.lexsort((a["classes"], a["hashes"]))
    h, cls, n, counted = (a[c][order] for c in ("hashes", "classes", "sizes", "counted"))
    first = np.concatenate(([True], h[1:] != h[:-1]))[:len(h)]
    group = np.cumsum(first) - 1
    new = first | np.concatenate(([True], cls[1:] != cls[:-1]))[:len(h)]
    of_two = np.bincount(group, weights=new) > 1
    of_two |= np.bincount(group, weights=n == 0) > 0  # known to be shared within a slice
    keep = of_two[group] & (n > 0) if len(h) else np.empty(0, bool)
    d = _read(table, DOCUMENT)
    out = [rows(SHARED, h[keep], cls[keep], n[keep], counted[keep]),
           rows(DOCUMENT, None, d["classes"], d["sizes"], None, d["ids"])]
    for kind in (SHARED, WHOLE):
        x = _read(table, kind)
        out.append(rows(kind, x["hashes"], x["classes"], x["sizes"], x["counted"]))
    return pa.concat_tables(out)


def linked(overlap, n, m):
    """The contract's rule for sets of n and m shingles."""
    return 100 * overlap >= PER_CENT * (n + m - overlap)


def sizes_may_link(n: str, m: str):
    """Whether sets of these sizes can link: the smaller may be the overlap."""
    return 100 * F.least(n, m) >= PER_CENT * F.greatest(n, m)


def least_common(n, m, reach_n, reach_m, low, high, up):
    """How many columns of step 3 two linking sets of n and m shingles have in
    common at least. With an overlap of at least c, a set lacks n - c at most; of
    the common ones, in the order of their hash, the first ``reach - (n - c)``
    are among its columns (``reach``: its columns and what it is known to have
    unshared before them). One at least, by the prefix filter."""
    c = up(PER_CENT * (n + m) / (100.0 + PER_CENT))
    return high(low(reach_n - (n - c), reach_m - (m - c)), 1)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        hit = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            hit.append(bool(linked(int((y[at] == x).sum()), len(x), len(y))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([v for v, k in zip(a, hit) if k], pa.int64()), pa.array([v for v, k in zip(b, hit) if k], pa.int64())],
            ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    x = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(
        _overlaps, "a bigint, b bigint")


def product(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks of sets, accumulated over slices of the
    columns that both have."""
    nx, ny = [len(s) for s in x], [len(s) for s in y]
    hx, hy = np.concatenate(x), np.concatenate(y)
    columns = np.intersect1d(hx, hy)
    out = np.zeros((len(x), len(y)), np.float32)

    def entries(h, lengths):
        at = np.searchsorted(columns, h)
        at[at == len(columns)] = 0
        real = columns[at] == h if len(columns) else np.zeros(len(h), bool)
        row, at = np.repeat(np.arange(len(lengths)), lengths)[real], at[real]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    (rx, cx), (ry, cy) = entries(hx, nx), entries(hy, ny)
    for first in range(0, len(columns), SLICE):
        width = min(SLICE, len(columns) - first)
        dense = []
        for r, c, n in ((rx, cx, len(x)), (ry, cy, len(y))):
            a, b = np.searchsorted(c, [first, first + width])
            m = np.zeros((n, width), np.float32)
            m[r[a:b], c[a:b] - first] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _store(folder: str):
    """Writes a block's members in two files: their columns, and their sets."""
    def run(table: pa.Table) -> pa.Table:
        fs, base = filesystem(folder)
        fs.create_dir(f"{base}/block_files", recursive=True)
        name = f"block_files/{uuid.uuid4().hex}"
        small = {c: table[c].to_numpy() for c in ("cls", "label", "n", "reach")}
        small["columns"] = [np.array(c, np.int64).view(np.uint64) for c in table["columns"].to_pylist()]
        for kind, data in (("columns", small), ("sets", [np.frombuffer(h, "<u8") for h in table["hashes"].to_pylist()])):
            with fs.open_output_stream(f"{base}/{name}.{kind}", compression=None) as out:
                out.write(pickle.dumps(data))
        return pa.table({"block": table["block"].slice(0, 1), "name": pa.array([name])})
    return run


def _products(folder: str):
    """Edges between components, from pairs of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)

        @lru_cache(4)
        def read(name: str):
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                return pickle.loads(f.read())

        for batch in batches:
            for first, second in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = list(_edges(read, first, second))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
    return run


def _edges(read, first: str, second: str) -> Iterator[tuple[int, int]]:
    x, y = read(f"{first}.columns"), read(f"{second}.columns")
    n, m = x["n"].astype(np.int64)[:, None], y["n"].astype(np.int64)[None, :]
    bound = least_common(n, m, x["reach"].astype(np.int64)[:, None], y["reach"].astype(np.int64)[None, :],
                         np.minimum, np.maximum, np.ceil)
    maybe = ((product(x["columns"], y["columns"]) >= bound) & (x["label"][:, None] != y["label"][None, :])
             & (100 * np.minimum(n, m) >= PER_CENT * np.maximum(n, m)))
    rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(rows):
        return
    xs, ys = read(f"{first}.sets"), read(f"{second}.sets")
    overlap = product([xs[i] for i in rows], [ys[j] for j in columns]).astype(np.int64)
    hits = maybe[np.ix_(rows, columns)] & linked(overlap, n[rows], m[:, columns])
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in np.argwhere(hits):
        i, j = rows[i], columns[j]
        a, b = find(int(x["label"][i])), find(int(y["label"][j]))
        if a != b:
            root[a] = b
            yield int(x["cls"][i]), int(y["cls"][j])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose class is asked for."""
    for part, texts in text_slices(batches):
        classes = part.column(part.schema.get_field_index("cls"))
        own = [shingles(t) for t in texts]
        right = [class_of(s) == c for s, c in zip(own, classes.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [classes.filter(pa.array(right, pa.bool_())),
             pa.array([s.astype("<u8").tobytes() for s, r in zip(own, right) if r], pa.binary())], ["cls", "hashes"])


def links(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, cls, n), and edges (a, b) between classes: every
    linking pair of classes, or a path of them."""
    spark = docs.sparkSession
    buckets = 2 * partitions(spark)
    source = docs.select("doc_id", "text")
    counts = written(source.mapInArrow(_incidence(buckets), MAPPED).groupBy("bucket").applyInArrow(_count, COUNTS),
                     folder, "counts")
    documents = counts.where(F.col("kind") == DOCUMENT).select("doc_id", "cls", "n")

    lack = F.expr(f"n - CAST(ceil({PER_CENT} * n / 100.0D) AS INT)")
    shared = (counts.where(F.col("kind") == SHARED).groupBy("cls", "n", "counted")
              .agg(F.sort_array(F.collect_set("h")).alias("hs"))
              .withColumn("lack", lack).withColumn("unshared", F.col("counted") - F.size("hs"))
              .where("counted > lack AND unshared <= lack"))
    # reach: the columns used, and the unshared ones
    entries = shared.select("cls", "n", F.least(F.col("lack") + 1, "counted").alias("reach"), (F.size("hs") / F.col("counted")).alias("share"),
                            F.explode(F.slice("hs", 1, F.col("lack") + 1 - F.col("unshared"))).alias("h"))
    whole = counts.where(F.col("kind") == WHOLE).select(
        "cls", "n", (lack + 1).alias("reach"), F.lit(0.0).alias("share"), "h").distinct()
    entries = written(entries.unionByName(whole), folder, "entries")

    columns = written(entries.groupBy("h").agg(
        F.count("*").alias("k"), F.min(F.struct(-F.col("share"), "n", "cls")).alias("lead")).where("k > 1"), folder, "columns")
    entries = written(attach(entries, columns, "h", "k", entries.count()), folder, "listed")
    first = entries.select(F.col("lead.cls").alias("a"), F.col("lead.n").alias("an"), F.col("cls").alias("b"), "n")
    pairs = written(first.where((F.col("a") != F.col("b")) & sizes_may_link("an", "n")).select("a", "b").distinct(),
                    folder, "pairs")

    named = documents.where("doc_id IS NOT NULL").groupBy("cls", "n").agg(F.min("doc_id").alias("doc_id"))
    wanted = entries.select("cls", "n").distinct().join(named, ["cls", "n"]).select("doc_id", "cls")
    sets = written(source.join(wanted, "doc_id").mapInArrow(_fetch, "cls bigint, hashes binary"), folder, "sets")
    if sets.count() != sets.select("cls").distinct().count():  # repeated rows
        sets = written(sets.dropDuplicates(["cls"]), folder, "sets_once")
    found = written(verified(pairs, sets), folder, "found_first")

    label = found.groupBy(F.col("b").alias("cls")).agg(F.min("a").alias("label"))
    entries = entries.where("k > 2").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    entries = written(entries, folder, "labelled")
    open_columns = entries.groupBy("h").agg(F.min("label").alias("l1"), F.max("label").alias("l2"),
                                            F.count("*").alias("w")).where("l1 <> l2").select("h", "w")
    entries = written(attach(entries, written(open_columns, folder, "open"), "h", "w", entries.count()), folder, "rest")

    short = entries.where((F.col("k") <= SHORT) & (F.col("cls") != F.col("lead.cls"))).select("h", "cls", "n", "label", "reach")
    other = short.select("h", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"),
                         F.col("reach").alias("reach_b"))
    met = (short.join(other, "h").where((F.col("cls") < F.col("b")) & (F.col("label") != F.col("other"))
                                        & sizes_may_link("n", "m"))
           .groupBy(F.col("cls").alias("a"), "b", "n", "m", "reach", "reach_b").agg(F.count("*").alias("common")))
    # all columns of a pair that has not met are here, or it shares a long one too and is in the blocks
    bound = least_common(F.col("n"), F.col("m"), F.col("reach"), F.col("reach_b"), F.least,
                         lambda v, least: F.greatest(v, F.lit(least)), F.ceil)
    more = met.where(F.col("common") >= bound).select("a", "b")
    found = found.unionByName(written(verified(written(more, folder, "more"), sets), folder, "found_short"))
    return documents, found.unionByName(_blocked(entries, sets, folder))


def _blocked(entries: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Edges among the classes of long columns, by products of blocks. Classes of
    one label share blocks if they are many, others the blocks of their smallest
    long column, so that classes that share columns share blocks."""
    long = F.col("k") > SHORT
    members = written(entries.groupBy("cls", "n", "label", "reach").agg(
        F.min(F.when(long, F.col("h"))).alias("least"), F.collect_list("h").alias("columns")
    ).where("least IS NOT NULL"), folder, "members")
    many = members.groupBy("label").agg(F.count("*").alias("w"))
    members = written(attach(members, many, "label", "w", members.count()).withColumn(
        "of", F.when(F.col("w") >= BLOCK_ROWS // 4, F.struct(F.lit(True).alias("one"), F.col("label").alias("key")))
        .otherwise(F.struct(F.lit(False).alias("one"), F.col("least").alias("key")))).drop("w"), folder, "grouped")
    sizes = members.groupBy("of").agg(F.count("*").alias("w"), F.ceil(F.greatest(
        F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_ENTRIES)).alias("blocks"))
    dealt = attach(members, sizes, "of", "w", members.count()).select(
        "cls", "label", "n", "reach", "columns",
        F.xxhash64("of", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("block"),
        F.when(F.col("of.one"), F.col("label")).alias("one"))
    dealt = written(dealt, folder, "dealt")
    blocks = written(dealt.join(sets, "cls").groupBy("block").applyInArrow(_store(folder), "block bigint, name string"),
                     folder, "blocks")
    at = written(entries.where(long).select("h", "cls").join(dealt.select("cls", "block", "one"), "cls")
                 .select("h", "block", "one").distinct(), folder, "at")
    other = at.select("h", F.col("block").alias("other"), F.col("one").alias("other_one"))
    pairs = at.join(other, "h").where((F.col("block") <= F.col("other"))
                                      & ~F.coalesce(F.col("one") == F.col("other_one"), F.lit(False)))
    x = blocks.select("block", F.col("name").alias("x"))
    y = blocks.select(F.col("block").alias("other"), F.col("name").alias("y"))
    pairs = written(pairs.select("block", "other").distinct().join(x, "block").join(y, "other").select("x", "y"),
                    folder, "block_pairs")
    return written(pairs.repartition(4 * partitions(entries.sparkSession)).sortWithinPartitions("x")
                   .mapInArrow(_products(folder), "a bigint, b bigint"), folder, "found_blocks")


def join(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id."""
    folder = shared_dir(docs.sparkSession)
    documents, edges = links(docs, folder)
    with_id = written(documents.where("doc_id IS NOT NULL").distinct(), folder, "documents")
    classes = written(with_id.groupBy("cls", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("w")),
                      folder, "classes")
    ends = classes.select(F.col("cls").alias("a"), F.col("node").alias("x"))
    others = classes.select(F.col("cls").alias("b"), F.col("node").alias("y"))
    nodes = edges.distinct().join(ends, "a").join(others, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(nodes, folder)
    per_class = classes.join(found, "node", "left").select(
        F.struct("cls", "n").alias("of"), F.coalesce("component", "node").alias("component"), "w")
    rows = with_id.select("doc_id", "n", F.struct("cls", "n").alias("of"))
    rows = attach(rows, written(per_class, folder, "per_class"), "of", "w", with_id.count())
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
                       ).unionByName(documents.where("doc_id IS NULL").select(
                           "doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is its component's smallest id."""
    gone = join(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
