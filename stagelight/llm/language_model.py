"""LM scoring (4): a weighted backoff automaton.

The model has orders 1 to ``ORDER``. Order 1 is the contract's base, the add-one
estimate over all words of the training texts. A longer n-gram is kept if it
occurs ``least`` times in the training texts, whatever their size, so the model
grows with the corpus. Kept n-grams are smoothed by interpolated absolute
discounting, which sums to one over all words and an unknown one.

As an automaton: the states are the empty context and the kept n-grams below the
highest order. An arc reads a word with the log-probability of a kept n-gram and
leads to the longest kept n-gram that then ends the text read so far. A failure arc
reads nothing: it drops the context's first word at the cost of its backoff weight.
A slice of documents gets the states and arcs that its n-grams can reach
(``Machine``); one traversal from left to right carries a state for each text and
adds up what its arcs cost. Long texts are cut into lanes that are walked side by
side: as a state knows ``ORDER - 1`` words, a lane that first reads so many words of
the one before it is in the state in which that one ends.

Counting covers all training documents, from the longest n-grams to the words. A
slice of documents is written as word numbers. Its distinct n-grams of an order go
with their counts to buckets by hash, which keep the model and answer with the
corpus totals, a file for each slice. One of the slices that have an n-gram is its
owner and adds its total to the n-gram's context, which goes to a bucket with the
next order. So no task or driver holds the vocabulary or the model, and an n-gram
or context that is in every text is one entry for each slice. The number of buckets
follows from the tokens counted, so that a bucket's n-grams fit a task at any size.

Defined results
* null and empty texts are the end token alone; so are texts of white space.
* Every row is scored, repeated rows too, and counted if it is a training row;
  null ids are training rows (crc32 of the empty text).
* Without training rows N and V are 0. An empty table gives no rows. Other columns
  are ignored.
* Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, give_back, partitions, shared_dir, shuffles_removed, single_rows, text_slices, written

ORDER = 3
#: An n-gram of two words or more is kept if it occurs so often, however large the corpus is.
LEAST = 1
DISCOUNT = 0.75
HELD_OUT_MOD, HELD_OUT = 7, 2
#: Text in a slice: a task holds some twenty numbers for each of its tokens.
SLICE_BYTES = 4 << 20
#: Tokens of training texts for each bucket of n-grams.
BUCKET_TOKENS = 400_000
#: Tokens of a lane of a long text.
LANE = 512
END_HASH = np.uint64(0)
SLICES = "slice string, doc_ids array<bigint>, lengths binary, held binary, tokens binary, words binary, n_train bigint"
DEALT = "bucket int, slice string, size int, start bigint, keys binary, counts binary, sums binary, continued binary"
ANSWERS = "slice string, bucket int, size int, totals binary, sums binary, continued binary, types bigint"
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
          "base_score double, score double")


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_MOD == HELD_OUT


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z, and white space \x20 \x09-\x0D


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) or 1  # 0 is the end token


def chained(contexts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of the n-grams without the last word and of the last word."""
    x = (contexts * np.uint64(0x9E3779B97F4A7C15)) ^ (last + np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of their bytes, which compress well, without
    the planes above the largest number."""
    numbers = np.ascontiguousarray(numbers, "<u8")
    planes = (int(numbers.max(initial=0)).bit_length() + 7) // 8
    return numbers.view("u1").reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked(planes: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), "u1")
    if size:
        own = np.frombuffer(planes, "u1").reshape(-1, size)
        out[:, :len(own)] = own.T
    return out.view("<i8").reshape(size)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of the slice's distinct words, each text with an end token."""
    for part, texts in text_slices(batches, SLICE_BYTES):
        ids = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()).to_pylist()
        hashes, lengths = [], []
        for t in texts:
            own = words(t)
            hashes.append(np.fromiter(map(word_hash, own), np.uint64, len(own)))
            hashes.append(np.array([END_HASH]))
            lengths.append(len(own) + 1)
        distinct, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        held = np.array([is_held_out(i) for i in ids])
        yield pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())),
             pa.array([np.array(lengths, "<i8").tobytes()]), pa.array([held.astype("u1").tobytes()]),
             pa.array([tokens.astype("<u4").tobytes()]), pa.array([distinct.astype("<u8").tobytes()]),
             pa.array([int(np.array(lengths)[~held].sum())], pa.int64())],
            ["slice", "doc_ids", "lengths", "held", "tokens", "words", "n_train"])


@dataclass
class Level:
    """A slice's n-grams of one order. ``keys``: ascending hashes of the distinct
    ones; ``contexts``: the numbers of their contexts in the order below; ``at``: for
    each token the number of the n-gram that ends there, -1 where a text is too short."""
    keys: np.ndarray
    contexts: np.ndarray
    at: np.ndarray


def levels(row: dict, order: int) -> list[Level]:
    tokens, lengths = np.frombuffer(row["tokens"], "<u4").astype(np.int64), np.frombuffer(row["lengths"], "<i8")
    first = np.zeros(len(tokens), bool)
    first[np.cumsum(lengths) - lengths] = True
    keys = np.frombuffer(row["words"], "<u8")
    last = keys[tokens]
    out = [Level(keys, np.full(len(keys), -1), tokens)]
    end = int(np.searchsorted(keys, END_HASH))  # a text's first word follows an end
    for k in range(2, order + 1):
        before = np.where(first, end if k == 2 else -1, np.concatenate(([-1], out[-1].at[:-1])))
        some = before >= 0
        keys, place = np.unique(chained(out[-1].keys[before[some]], last[some]), return_inverse=True)
        at, contexts = np.full(len(tokens), -1), np.full(len(keys), -1)
        at[some], contexts[place] = place, before[some]
        out.append(Level(keys, contexts, at))
    return out


def _answer_file(folder: str, order: int, slice_id: str) -> str:
    return f"{folder}/totals-{order}/{slice_id}"


def _answers(folder: str, order: int, slice_id: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice's distinct n-grams: totals (0 if not kept), whether the slice is
    the owner, and the sum and number of kept n-grams of which each is the context."""
    fs, path = filesystem(_answer_file(folder, order, slice_id))
    with fs.open_input_stream(path, compression="zstd") as f:
        totals, sums, continued = np.frombuffer(f.read(), "<i8").reshape(3, -1)
    return totals >> 1, (totals & 1).astype(bool), sums, continued


def _dealt(folder: str, order: int, top: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A slice's distinct n-grams of ``order`` words by bucket of the hash: how often
    they are in its training texts, and what it owns of the kept n-grams that continue them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            own = levels(row, min(order + 1, top))
            keys, at = own[order - 1].keys, own[order - 1].at
            train = ~np.repeat(np.frombuffer(row["held"], "u1").astype(bool), np.frombuffer(row["lengths"], "<i8"))
            counts = np.bincount(at[train & (at >= 0)], minlength=len(keys))
            sums = continued = np.zeros(len(keys), np.int64)
            if order < top:
                totals, owner, _, _ = _answers(folder, order + 1, row["slice"])
                owner &= totals > 0
                contexts = own[order].contexts[owner]
                sums = np.bincount(contexts, totals[owner], len(keys)).astype(np.int64)
                continued = np.bincount(contexts, minlength=len(keys))
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            parts = [(b, slice(cut[b], cut[b + 1])) for b in range(buckets) if cut[b] < cut[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in parts], pa.int32()), pa.array([row["slice"]] * len(parts), pa.string()),
                 pa.array([p.stop - p.start for _, p in parts], pa.int32()),
                 pa.array([int(keys[p.start].astype(np.int64)) for _, p in parts], pa.int64()),
                 pa.array([packed(np.diff(keys[p])) for _, p in parts], pa.binary()),
                 *(pa.array([packed(x[p]) for _, p in parts], pa.binary()) for x in (counts, sums, continued))],
                ["bucket", "slice", "size", "start", "keys", "counts", "sums", "continued"])
    return run


def _totals(order: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket's answers to each slice: the totals of its n-grams. Its first answer
    carries the bucket's number of different words."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        keys = np.concatenate([
            np.concatenate(([start], unpacked(steps, n - 1))).cumsum().view(np.uint64)
            for start, steps, n in zip(table["start"].to_pylist(), table["keys"].to_pylist(), sizes)])
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)

        def summed(column: str) -> np.ndarray:
            own = np.concatenate([unpacked(x, n) for x, n in zip(table[column].to_pylist(), sizes)])
            return np.bincount(place, own, len(distinct)).astype(np.int64)

        totals, sums, continued = summed("counts"), summed("sums"), summed("continued")
        types = int((totals > 0).sum())
        if order > 1:
            totals[totals < least] = 0
        owner = np.zeros(len(place), np.int64)
        owner[first] = 1
        cut = np.cumsum([0, *sizes])
        answer = [place[a:b] for a, b in zip(cut, cut[1:])]
        return pa.table({
            "slice": table["slice"], "bucket": table["bucket"], "size": table["size"],
            "totals": pa.array([packed(totals[p] << 1 | owner[a:b]) for p, a, b in zip(answer, cut, cut[1:])], pa.binary()),
            "sums": pa.array([packed(sums[p]) for p in answer], pa.binary()),
            "continued": pa.array([packed(continued[p]) for p in answer], pa.binary()),
            "types": pa.array([types] + [0] * (len(sizes) - 1), pa.int64())})
    return run


def _gathered(folder: str, order: int) -> Callable[[pa.Table], pa.Table]:
    """Writes a slice's answers, in the order of its n-grams, as its file."""
    def run(table: pa.Table) -> pa.Table:
        by = np.argsort(table["bucket"].to_numpy())
        sizes = table["size"].to_pylist()
        slice_id = table["slice"][0].as_py()
        fs, path = filesystem(_answer_file(folder, order, slice_id))
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own, compression="zstd") as out:
            for column in ("totals", "sums", "continued"):
                parts = table[column].to_pylist()
                out.write(np.concatenate([unpacked(parts[i], sizes[i]) for i in by]).tobytes())
        fs.move(own, path)  # all attempts write the same
        return pa.table({"slice": [slice_id]})
    return run


def _base(counts: np.ndarray, n: int, types: int) -> np.ndarray:
    """The add-one estimate of words with these counts."""
    return (counts + 1.0) / (n + types + 1.0)


def _spare(totals: np.ndarray, sums: np.ndarray, continued: np.ndarray) -> np.ndarray:
    """What the kept n-grams that continue a context leave of its probability."""
    return 1.0 - (sums - DISCOUNT * continued) / np.maximum(totals, 1)


def train(slices: DataFrame, folder: str, order: int = ORDER, least: int = LEAST) -> tuple[int, int]:
    """Counts all training n-grams of the written slices and leaves each slice's
    totals in its files; the number of training tokens and of different ones."""
    spark = slices.sparkSession
    n, tokens = slices.agg(F.sum("n_train"), F.sum(F.octet_length("tokens"))).first()
    buckets = max(2 * partitions(spark), (tokens or 0) // 4 // BUCKET_TOKENS + 1)
    types = 0
    with shuffles_removed(spark):
        for k in range(order, 0, -1):  # an n-gram's total counts for its context
            totals = written(slices.select("slice", "lengths", "held", "tokens", "words")
                             .mapInArrow(_dealt(folder, k, order, buckets), DEALT)
                             .groupBy("bucket").applyInArrow(_totals(k, least), ANSWERS), folder, f"answers-{k}")
            written(totals.drop("types").groupBy("slice")
                    .applyInArrow(_gathered(folder, k), "slice string"), folder, f"gathered-{k}")
            if k == 1:
                types = totals.agg(F.sum("types")).first()[0] or 0
    return n or 0, types


@dataclass
class Machine:
    """States and arcs that a slice's texts can reach. State 0 is the empty context.
    From there each word has an arc (``base``, ``home``); the arcs of other states
    are sorted by state * words + word. ``begin`` is the state before a text."""
    words: int
    begin: int
    base: np.ndarray
    home: np.ndarray
    fail: np.ndarray
    weight: np.ndarray
    arcs: np.ndarray
    cost: np.ndarray
    to: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a word in each state: the states after it, and the log10 probabilities."""
        after, p = np.empty_like(state), np.zeros(len(state))
        state, todo = state.copy(), np.arange(len(state))
        while len(todo):
            root = todo[state[todo] == 0]
            p[root] += self.base[word[root]]
            after[root] = self.home[word[root]]
            todo = todo[state[todo] > 0]
            wanted = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            found = self.arcs[at] == wanted if len(self.arcs) else np.zeros(len(todo), bool)
            read, at = todo[found], at[found]
            p[read] += self.cost[at]
            after[read] = self.to[at]
            todo = todo[~found]  # these take their failure arcs
            p[todo] += self.weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return after, p

    def traverse(self, tokens: np.ndarray, lengths: np.ndarray, order: int, lane: int) -> np.ndarray:
        """log10 probability of each token, texts of ``lengths`` one after another."""
        ends = np.cumsum(lengths)
        cuts = -(-lengths // lane)
        number = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        text_start, text_end = np.repeat(ends - lengths, cuts), np.repeat(ends, cuts)
        own = text_start + number * lane  # from here on a lane's costs count
        start = np.maximum(text_start, own - (order - 1))
        stop = np.minimum(own + lane, text_end)
        by = np.argsort(start - stop, kind="stable")  # longest first: those that go on are a prefix
        own, start, size = own[by], start[by], (stop - start)[by]
        state = np.where(start == text_start[by], self.begin, 0)
        out = np.zeros(len(tokens))
        for k in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -k))  # lanes longer than k
            at = start[:m] + k
            state[:m], p = self.step(state[:m], tokens[at])
            counts = at >= own[:m]
            out[at[counts]] = p[counts]
        return out


def machine(own: list[Level], answers: Iterable[tuple], n: int, types: int) -> Machine:
    """The automaton of a slice from its n-grams and their corpus totals, an entry
    for each order; those of one order are held at once."""
    answers = iter(answers)
    totals, _, sums, continued = next(answers)
    words, tokens = len(totals), own[0].at
    p = _base(totals, n, types)
    states = np.where(totals > 0, 1 + np.arange(words), 0)  # of each n-gram of the order below
    base, home = np.log10(p), states
    fail, weight = [np.zeros(1 + words, np.int64)], [np.r_[0.0, np.log10(_spare(totals, sums, continued))]]
    arcs, cost, to, used = [], [], [], 1 + words
    for k in range(1, len(own)):
        level, spare, context = own[k], _spare(totals, sums, continued), totals
        totals, _, sums, continued = next(answers)
        some = level.at >= 0
        shorter, last = np.zeros(len(totals), np.int64), np.zeros(len(totals), np.int64)
        shorter[level.at[some]], last[level.at[some]] = own[k - 1].at[some], tokens[some]
        kept = np.flatnonzero(totals > 0)
        p = spare[level.contexts] * p[shorter] + np.where(
            totals > 0, (totals - DISCOUNT) / np.maximum(context[level.contexts], 1), 0.0)
        arcs.append(states[level.contexts[kept]] * words + last[kept])
        cost.append(np.log10(p[kept]))
        suffix = states[shorter[kept]]
        if k == len(own) - 1:
            to.append(suffix)
            continue
        states = np.zeros(len(totals), np.int64)
        states[kept] = used + np.arange(len(kept))
        used += len(kept)
        to.append(states[kept])
        fail.append(suffix)
        weight.append(np.log10(_spare(totals, sums, continued)[kept]))
    arc, cost, to = (np.concatenate(x) if x else np.empty(0) for x in (arcs, cost, to))
    order = np.argsort(arc)
    end = int(np.searchsorted(own[0].keys, END_HASH))
    return Machine(words, int(home[end]), base, home, np.concatenate(fail), np.concatenate(weight),
                   arc[order], cost[order], to[order].astype(np.int64))


def _scored(folder: str, n: int, types: int, order: int, lane: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            own = levels(row, order)
            model = machine(own, (_answers(folder, k + 1, row["slice"]) for k in range(order)), n, types)
            tokens, lengths = own[0].at, np.frombuffer(row["lengths"], "<i8")
            del own
            give_back()
            known = (model.home[tokens] > 0).astype(np.int64)
            p = model.traverse(tokens, lengths, order, lane)
            sums = [np.add.reduceat(x, np.cumsum(lengths) - lengths) for x in (known, model.base[tokens], p)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(np.frombuffer(row["held"], "u1").astype(bool)),
                 pa.array(lengths), pa.array(sums[0]), pa.array(np.full(len(lengths), n, np.int64)),
                 pa.array(sums[1]), pa.array(sums[2])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, order: int = ORDER, least: int = LEAST, lane: int = LANE) -> DataFrame:
    """For each document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    slices = written(docs.select("doc_id", "text").mapInArrow(_slices, SLICES), folder, "slices")
    n, types = train(slices, folder, order, least)
    return slices.mapInArrow(_scored(folder, n, types, order, lane), SCORES)


def op4_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The scores in SQL. The empty word is the end of a text, and what stands before its
#: first word. Not registered for comparison by hash: sums of doubles depend on their
#: order, so a test compares them within a tolerance.
SCORES_SQL = f"""
WITH bytes AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, (4294967295 - list_reduce(list_prepend(4294967295,
      list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: x <> ''),
        lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) % {HELD_OUT_MOD} = {HELD_OUT} AS held,
    list_concat([''], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ['']) AS x FROM documents CROSS JOIN bytes),
tokens AS MATERIALIZED (SELECT r, held, x[i] AS w, x[i - 1] AS h, CASE WHEN i > 2 THEN x[i - 2] END AS g
  FROM (SELECT *, unnest(range(2, len(x) + 1)) AS i FROM texts)),
one AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held GROUP BY w),
size AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM one),
two AS (SELECT h, w, count(*) AS c FROM tokens WHERE NOT held GROUP BY ALL HAVING count(*) >= {LEAST}),
three AS (SELECT g, h, w, count(*) AS c FROM tokens WHERE NOT held AND g IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
after_one AS (SELECT h, sum(c - {DISCOUNT}) AS s FROM two GROUP BY h),
after_two AS (SELECT g, h, sum(c - {DISCOUNT}) AS s FROM three GROUP BY g, h),
p1 AS (SELECT t.*, one.c, (coalesce(one.c, 0) + 1) / (n + v + 1) AS p1 FROM tokens t CROSS JOIN size LEFT JOIN one USING (w)),
p2 AS (SELECT p1.*, coalesce((two.c - {DISCOUNT}) / hc.c, 0) + (1 - coalesce(a.s / hc.c, 0)) * p1 AS p2
  FROM p1 LEFT JOIN one hc ON hc.w = p1.h LEFT JOIN two ON two.h = p1.h AND two.w = p1.w LEFT JOIN after_one a ON a.h = p1.h),
p3 AS (SELECT p2.*, CASE WHEN gh.c IS NULL THEN p2
    ELSE coalesce((three.c - {DISCOUNT}) / gh.c, 0) + (1 - coalesce(a.s / gh.c, 0)) * p2 END AS p3
  FROM p2 LEFT JOIN two gh ON gh.h = p2.g AND gh.w = p2.h LEFT JOIN after_two a ON a.g = p2.g AND a.h = p2.h
  LEFT JOIN three ON three.g = p2.g AND three.h = p2.h AND three.w = p2.w)
SELECT any_value(texts.doc_id) AS doc_id, any_value(texts.held) AS held_out, count(*) AS n_tokens, count(p3.c) AS n_known,
  CAST(any_value(n) AS BIGINT) AS train_tokens, sum(log10(p1)) AS base_score, sum(log10(p3)) AS score
FROM p3 JOIN texts USING (r) CROSS JOIN size GROUP BY r"""
