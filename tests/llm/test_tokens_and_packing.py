"""The encoder, packing, and Simple-8b files."""

from __future__ import annotations

import io
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagelight.llm import packing as P
from stagelight.llm import simple8b as S
from stagelight.llm import tokens as T

from .brute import crc_of_ids, token_ids
from .conftest import as_rows, odd_rows, texts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t\r  ​ab.,'é😀1<|>%xS\x00\x85\x1c")), max_size=30), max_size=6))
def test_units_give_the_ids_of_whole_texts(many):
    encoder = T.encoder("byte_bpe_50k.json")
    assert encoder.encode(many) == [np.array(token_ids(t), "<u4").tobytes() for t in many]


def test_cache_generations_change_nothing(monkeypatch, documents):
    own = [t for _, t in texts(documents)] + [r[1] or "" for r in odd_rows()]
    monkeypatch.setattr(T, "CACHE_UNITS", 500)
    small = T.Encoder(T.vocabulary_path())
    for k in range(0, len(own), 9):
        assert small.encode(own[k:k + 9]) == [np.array(token_ids(t), "<u4").tobytes() for t in own[k:k + 9]]


def check_pieces(docs, rows, window):
    """Every id lies in one piece, sequences are gapless, one has padding at most."""
    encoded = Counter()
    for i, t in docs:
        encoded[i, tuple(token_ids(t) + [0])] += 1
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]][r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(n * len(ids) for (_, ids), n in encoded.items())
    assert sum(r["length"] for r in rows) == total
    for (i, ids), n in encoded.items():
        own = pieces[i, len(ids)]
        for (start, length, crc), count in own.items():
            assert 0 < length <= window and start + length <= len(ids)
        covered = sum(length * c for (start, length, crc), c in own.items()
                      if crc == crc_of_ids(ids[start:start + length]))
        assert covered >= n * len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert sum(window - sum(n for _, n in p) for p in sequences.values()) < window


@pytest.mark.parametrize("window", [1024, 16])
def test_packing(documents, odd, window):
    for df in (documents, odd):
        check_pieces(texts(df), P.pack(df, window=window).collect(), window)


def test_packing_nothing(empty):
    assert P.pack(empty).count() == 0


def test_least_squares_finds_an_exact_mix():
    combos = P.combinations(64)
    assert (combos.sum(axis=1) == 64).all() and len(np.unique(combos, axis=0)) == len(combos)
    histogram = np.zeros(64, np.int64)
    for a, b, n in ((10, 54, 70), (32, 32, 20), (1, 63, 5)):
        histogram[a] += n
        histogram[b] += n
    plan = P.make_plan(histogram, 64)
    assert plan.combined == 95 and (plan.taken == histogram).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2 ** 64 - 1),
                          st.just(int(S.ESCAPE)), st.integers(2 ** 60 - 2, 2 ** 60 + 2)), max_size=300), st.integers(1, 60))
def test_simple8b_round_trip(some, times):
    ids = np.array(some * times, np.uint64)
    words, offsets = S.encode(ids)
    assert (S.decode(words, len(ids)) == ids).all()
    ends = [*offsets[1:].tolist(), len(words)]
    for k, (a, b) in enumerate(zip(offsets.tolist(), ends)):
        assert (S.decode(words[a:b], S.BLOCK)[:len(ids) - k * S.BLOCK] == ids[k * S.BLOCK:(k + 1) * S.BLOCK]).all()


def test_file_seeks_blocks():
    rng = np.random.default_rng(3)
    docs = [(k, rng.integers(0, 50_257, n).astype(np.uint32)) for k, n in enumerate((1, 9000, 0, 300_000, 5, 4096))]
    out = io.BytesIO()
    writer = S.Writer(out)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = S.Reader(pa.BufferReader(out.getvalue()))
    assert [(i, x.tolist()) for i, x in reader.documents(3)] == [(i, x.tolist()) for i, x in docs]
    whole = np.concatenate([x for _, x in docs])
    assert (reader.blocks(5, 7) == whole[5 * S.BLOCK:7 * S.BLOCK]).all()


def brute_files(docs):
    out, start = [], 0
    encoded = [(i, token_ids(t) + [2]) for i, t in docs]
    for i, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0] or 0, crc_of_ids(x[1]))):
        out.append((i, start, len(ids), crc_of_ids(ids)))
        start += len(ids)
    return sorted(out, key=repr)


def test_token_files(documents, odd, empty):
    for df in (documents, odd):
        assert as_rows(S.token_files(df)) == brute_files(texts(df))
    assert S.token_files(empty).count() == 0


def test_one_row_a_third_of_the_table(spark, documents):
    """Copies of one row are dealt to all buckets, and each is packed."""
    own = texts(documents)
    copies = [(7, own[7][1])] * (len(own) // 2)
    rows = P.pack(spark.createDataFrame(own + copies, "doc_id bigint, text string")).collect()
    check_pieces(own + copies, rows, 1024)
    tokens = spark.createDataFrame([(1, 5, [], 5, 9, b"", k) for k in range(4000)],
                                   "doc_id bigint, doc_tokens bigint, crcs array<bigint>, tail_length int, tail_crc bigint, tail binary, row bigint")
    ranked = P.ranked(tokens, 16)
    assert sorted(r["rank"] for r in ranked.select("rank").collect()) == list(range(4000))
    buckets = tokens.groupBy(F.pmod(F.xxhash64("row"), F.lit(16))).count().collect()
    assert len(buckets) == 16 and max(r["count"] for r in buckets) < 500


def test_the_store_keeps_what_it_is_asked_for():
    store = T.UnitStore(4)
    first = np.array([9, 3, 7], np.uint64)
    store.add(first, [b"9", b"3", b"7"], np.empty(0, np.int64))
    rows = store.find(np.array([3, 8, 9], np.uint64))
    assert rows[1] == -1 and [store.ids[int(r)].as_py() for r in rows[[0, 2]]] == [b"3", b"9"]
    store.add(np.array([8, 1], np.uint64), [b"8", b"1"], rows[[0, 2]])  # beyond the limit: 7 goes
    rows = store.find(np.array([3, 9, 8, 1, 7], np.uint64))
    assert rows[4] == -1 and [store.ids[int(r)].as_py() for r in rows[:4]] == [b"3", b"9", b"8", b"1"]
