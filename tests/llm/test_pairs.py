"""N-gram Jaccard join, its products and the connected components."""

from __future__ import annotations

import random

import numpy as np
import pytest

from stagelight.llm import ngram_join as N
from stagelight.llm.common import shared_dir
from stagelight.llm.components import components

from .brute import near_components, shingle_set
from .conftest import as_rows, invented, texts


def brute(docs):
    comp = near_components(docs)
    out = [(i, len(s), c) for (i, s), c in comp.items()]
    return sorted([*out, *((None, len(shingle_set(t)), None) for i, t in docs if i is None)], key=repr)


def test_odd_rows(odd):
    assert as_rows(N.join(odd)) == brute(texts(odd))


def test_documents(documents):
    assert as_rows(N.join(documents)) == brute(texts(documents))


def test_empty(empty):
    assert N.join(empty).count() == 0 and N.one_of_each(empty).count() == 0


def edited(rng, words, most):
    out = list(words)
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(out))
        out[k:k + 1] = rng.choice([[], [out[k], "x%d" % rng.randrange(9)], ["y%d" % rng.randrange(99)]])
    return " ".join(out)


@pytest.mark.parametrize("short,rows", [(32, 256), (3, 8)])
def test_group_of_near_copies_around_the_bound(spark, monkeypatch, short, rows):
    """Long and short columns, blocks, and chains of links just above 0.75."""
    monkeypatch.setattr(N, "SHORT", short)
    monkeypatch.setattr(N, "BLOCK_ROWS", rows)
    rng = random.Random(short)
    base, passage = invented(rng, 90).split(), invented(rng, 25).split()
    docs = [edited(rng, base, 5) for _ in range(90)] + [edited(rng, base[:40] + passage, 3) for _ in range(40)]
    docs += [" ".join(passage) + " " + invented(rng, rng.randint(1, 60)) for _ in range(60)]
    docs += [edited(rng, passage[:9], 1) for _ in range(20)]
    rng.shuffle(docs)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = as_rows(N.join(df))
    assert got == brute(list(enumerate(docs)))
    assert 1 < len({c for *_, c in got}) < len(docs) - 40
    kept = N.one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in got})


def test_product_counts_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in rng.integers(1, 6000, 12)]
    got = N.product(sets[:7], sets[5:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:7]]).all()


def test_one_of_each_keeps_columns_and_rows_without_id(odd):
    kept = N.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.where("doc_id IS NULL").count() == 2
    assert {r["doc_id"] for r in kept.collect()} == {c for *_, c in as_rows(N.join(odd))}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + \
            [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(90)] + [(5, 5)]
    comp = {}
    for a, b in edges:
        if a != b:
            ca, cb = comp.get(a, {a}), comp.get(b, {b})
            for x in ca | cb:
                comp[x] = ca | cb
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), shared_dir(spark))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: min(c) for x, c in comp.items()}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), shared_dir(spark)).count() == 0


def test_slices_that_begin_alike_are_dealt_over_the_buckets(spark):
    from pyspark.sql import functions as F
    same = "one group of copies begins every slice of the documents here"
    docs = spark.range(0, 160, numPartitions=16).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 5, same).otherwise(
            F.concat(F.lit(same + " "), F.col("id").cast("string"))).alias("text"))
    rows = docs.mapInArrow(N._incidence(24), N.MAPPED).where(F.col("kind") != N.ASK).collect()
    for kind in {r["kind"] for r in rows}:
        buckets = [r["bucket"] for r in rows if r["kind"] == kind]
        assert len(set(buckets)) >= 6, kind
    assert sum(len(r["ids"]) // 8 for r in rows) == 160
