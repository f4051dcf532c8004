"""Quality rules (13): tokeniser fertility, with rejection bands per language.

Two public vocabularies measure each text, word by word: the byte-level BPE gives
characters per token and the entropy of the text's token ids, the piece vocabulary
the share of pieces that fall back to single bytes. A text whose measures leave the
bands of its language is rejected. The language is the column ``lang``, or, where
that is absent, null or empty, the script that most words of the text begin with.

Bands come from all texts of a language, by length class (powers of two of the
number of words, since entropy and scatter change with length): quartiles of the
texts that the plain rules leave, and from them ``FENCE`` interquartile ranges and
a tolerance to either side. The quartiles are those of whole numbers (measures
times ``STEPS``), so the aggregate holds one counter for each such number.

Plain rules, for every text: fewer than ``LEAST_WORDS`` words, or more than half of
the words in 3-word windows that the text repeats.

Distinct words are encoded once per worker (a bounded memory), all else of a text
is arithmetic on arrays of word numbers. A task holds one slice of texts at once.

Defined results
* null and empty texts have no words, measure nothing and fail the plain rules.
* Repeated rows and rows of one id are measured each for itself (the bands count
  each). A null doc_id is carried.
* A language with a single text in a length class keeps it. An empty table gives
  an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GIVE_UP, attach, shared_dir, text_slices, written
from .tokens import encoder, vocabulary_path

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
LEAST_WORDS = 50
#: Repeated words are too many beyond this share of all, in per cent.
REPEATED_PER_CENT = 50
SYMBOLS = b"#*$%&|<>"
#: Measures are compared as whole numbers of this many steps per unit.
STEPS = 1000
#: Interquartile ranges that a band reaches beyond the quartiles, and a tolerance
#: (in steps) for languages whose texts hardly differ.
FENCE = 3.0
TOLERANCE = {"chars_per_token": 250, "byte_share": 20, "evenness": 30}
#: Distinct words that a worker remembers.
WORDS = 400_000
#: Bytes of one text that are cut into words at once.
CHUNK = 4 << 20
MEASURES = list(TOLERANCE)
MEASURED = ("doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
            "n_repeat_words bigint, n_tokens bigint, script string, chars_per_token bigint, byte_share bigint, "
            "evenness bigint")
_METERS: dict[tuple[str, str], "Meter"] = {}
GIVE_UP.append(_METERS.clear)


class Numbers(dict):
    """Numbers words as they first come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Meter:
    """What a worker knows of words: number, code points, tokens, pieces, script."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        from sentencepiece import SentencePieceProcessor
        self.names = byte_vocabulary
        self.pieces = SentencePieceProcessor(model_file=piece_vocabulary if "/" in piece_vocabulary
                                             else vocabulary_path(piece_vocabulary))
        self.is_byte = np.array([self.pieces.IsByte(k) for k in range(self.pieces.vocab_size())])
        self.scripts: dict[str, int] = {}
        self.letters: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.chars, self.script, self.piece_count, self.byte_count = (np.empty(0, np.int64) for _ in range(4))
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def codes(self, text: bytes) -> np.ndarray:
        """The text's words as numbers; white space is \\x20 and \\x09-\\x0D."""
        out, at = [], 0
        while at < len(text):
            to = len(text)
            if to - at > CHUNK:
                cut = re.compile(rb"[\x20\x09-\x0D]").search(text, at + CHUNK)
                to = cut.start() if cut else to
            words = text[at:to].split()
            out.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            at = to
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def learn(self) -> None:
        """Measures the words that were numbered since the last call."""
        known = len(self.chars)
        if known == len(self.numbers):
            return
        new = [w.decode() for w in list(self.numbers)[known:]]
        found = encoder(self.names).unit_ids([" " + w for w in new])
        pieces = self.pieces.encode(new, num_threads=1)
        add = lambda old, values: np.r_[old, np.array(values, np.int64)]
        starts = np.r_[0, np.cumsum([len(p) for p in pieces])]
        bytes_in = np.r_[0, np.cumsum(self.is_byte[np.fromiter(chain.from_iterable(pieces), np.int64, starts[-1])])]
        self.chars = add(self.chars, [len(w) for w in new])
        self.script = add(self.script, [self.script_of(w) for w in new])
        self.piece_count = add(self.piece_count, np.diff(starts))
        self.byte_count = add(self.byte_count, np.diff(bytes_in[starts]))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) // 4 for f in found])])

    def script_of(self, word: str) -> int:
        """The number of the script of a word's first letter, by its Unicode name."""
        letter = word[0] if word[0].isalpha() else next((c for c in word if c.isalpha()), " ")
        if letter not in self.letters:
            name = unicodedata.name(letter, "NONE").split(" ")[0] if letter != " " else "NONE"
            self.letters[letter] = self.scripts.setdefault(name, len(self.scripts))
        return self.letters[letter]

    def token_counts(self, codes: np.ndarray) -> np.ndarray:
        """How often each distinct token id occurs in the words."""
        own, times = np.unique(codes, return_counts=True)
        first, lengths = self.ends[own], self.ends[own + 1] - self.ends[own]
        total = int(lengths.sum())
        if not total:
            return np.empty(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        ids = self.ids[np.repeat(first - starts, lengths) + np.arange(total)]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        return np.add.reduceat(np.repeat(times, lengths)[order], np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]))


def meter(byte_vocabulary: str, piece_vocabulary: str) -> Meter:
    key = byte_vocabulary, piece_vocabulary
    if key not in _METERS:
        _METERS[key] = Meter(*key)
    return _METERS[key]


def repeated_words(codes: np.ndarray) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    if codes.max() < 1 << 21:
        windows = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    else:  # windows numbered in two steps, so that no number leaves 64 bits
        _, dense = np.unique(codes, return_inverse=True)
        span = int(dense.max()) + 1
        _, pairs = np.unique(dense[:-1] * span + dense[1:], return_inverse=True)
        windows = pairs[:-1] * span + dense[2:]
    _, own, times = np.unique(windows, return_inverse=True, return_counts=True)
    many = times[own] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k:k + n] |= many
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def measured(m: Meter, text: bytes, codes: np.ndarray) -> tuple:
    """The columns of ``MEASURED`` after doc_id and lang."""
    chars = int(m.chars[codes].sum())
    counts = m.token_counts(codes)
    tokens, pieces = int(counts.sum()), int(m.piece_count[codes].sum())
    evenness = 1.0
    if len(counts) and tokens > 1:
        p = counts / tokens
        evenness = float(-(p * np.log2(p)).sum()) / np.log2(tokens)
    script = list(m.scripts)[int(np.bincount(m.script[codes]).argmax())] if len(codes) else "NONE"
    return (len(codes), chars, len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text),
            repeated_words(codes), tokens, script, round(STEPS * chars / max(1, tokens)),
            round(STEPS * int(m.byte_count[codes].sum()) / max(1, pieces)), round(STEPS * evenness))


def _measure(byte_vocabulary: str, piece_vocabulary: str):
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64())
                        for f in MEASURED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, as_text=True):  # words stay known from task to task
            texts = [t.encode() for t in texts]
            m = meter(byte_vocabulary, piece_vocabulary)
            if len(m.numbers) > WORDS:
                m.forget()
            codes = [m.codes(t) for t in texts]
            m.learn()
            rows = zip(*(measured(m, t, c) for t, c in zip(texts, codes)))
            columns = [part.column(0), part.column(1), *map(list, rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type)
                                              for c, f in zip(columns, schema)], schema=schema)
    return run


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PER_CENT * F.col("n_words"))


def bands(rows: DataFrame, fence: float = FENCE) -> DataFrame:
    """For each ``band`` its number of texts and, for each measure, its limits,
    from the texts that the plain rules leave."""
    quartiles = [F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in MEASURES]
    found = rows.where(~F.col("base_failed")).groupBy("band").agg(*quartiles)
    limits = []
    for m in MEASURES:
        low, high = F.col(m)[0], F.col(m)[1]
        reach = fence * (high - low) + TOLERANCE[m]
        limits += [(low - reach).alias(f"{m}_low"), (high + reach).alias(f"{m}_high")]
    return found.select("band", *limits)


def judge(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY,
          fence: float = FENCE) -> DataFrame:
    """A row for each document: counts, measures, limits of its band, verdict."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(
        _measure(byte_vocabulary, piece_vocabulary), MEASURED)
    group = F.when(F.coalesce(F.col("lang"), F.lit("")) == "", F.concat(F.lit("script "), "script")) \
        .otherwise(F.concat(F.lit("lang "), "lang"))
    length = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))).cast("string")
    rows = written(rows.withColumn("base_failed", base_failed())
                   .withColumn("band", F.concat_ws(" ", group, length)), folder, "measured")
    sizes = rows.groupBy("band").agg(F.count("*").alias("band_docs"))
    limits = written(sizes.join(bands(rows, fence), "band", "left"), folder, "bands")
    judged = attach(rows, limits, "band", "band_docs", rows.count())
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op13_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", *[(F.col(m) / STEPS).alias(m) for m in MEASURES])
