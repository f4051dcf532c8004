"""Toxicity and quality: held-out accuracy and edges."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from stagelight.llm import quality as Q
from stagelight.llm import toxicity as X

LARGER = "/root/testdata/sf0.1"


def held_out(i) -> bool:
    return zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2


@pytest.mark.parametrize("run,column,threshold,least", [
    (X.toxicity, "toxic", 0.3, 0.95), (Q.quality, "quality", 0.7, 0.95)])
def test_held_out(spark, run, column, threshold, least):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = run(spark.read.parquet(f"{LARGER}/documents.parquet"), labels).collect()
    known = {r["doc_id"]: r[column] for r in labels.collect()}
    assert len(rows) == 10_000
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == held_out(r["doc_id"])
    mine = [(r["score"], known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    score, label, predicted = (np.array(x) for x in zip(*mine))
    better = (score[label == 1][:, None] > score[label == 0][None, :]).mean()
    assert better > least and (predicted == label).mean() > 0.95


@pytest.mark.parametrize("run", [X.toxicity, Q.quality])
def test_odd_rows(run, odd, empty, labels):
    rows = run(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1  # null is empty
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert run(empty, labels).count() == 0


@pytest.mark.parametrize("run,column", [(X.toxicity, "toxic"), (Q.quality, "quality")])
def test_labels_that_teach_nothing(spark, run, column, documents, labels):
    none = labels.where("doc_id < 0")
    assert {r["score"] for r in run(documents, none).collect()} == {0.5}
    one = labels.where(f"{column} = 1")
    assert all(0.5 < r["score"] <= 1 for r in run(documents, one).collect())
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (10 ** 9, 0, 1)], labels.schema)
    assert run(documents, nulls).count() == documents.count()


def test_labels_of_held_out_rows_are_not_used(documents, labels):
    from pyspark.sql import functions as F
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    assert X.toxicity(documents, labels).collect() == X.toxicity(documents, turned).collect()


def test_clean_rows_keep_columns(odd, labels):
    kept = X.clean_rows(odd, labels)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    scores = X.toxicity(odd, labels).collect()
    assert kept.count() == sum(1 - r["predicted"] for r in scores)


def test_features_are_words_pairs_and_skips():
    f = lambda t: set(X.features(t.encode()).tolist())
    assert len(X.features(b"a b c d")) == 4 + 3 + 2
    assert f("A, b!") == f("a b") and f("a b") != f("b a")
    assert f("a x c") & f("a y c") == f("a") | f("c") | (f("a x c") - f("a x") - f("x c"))


def test_ftrl_learns_a_sparse_rule():
    rng = np.random.default_rng(0)
    model = X.Ftrl(np.zeros(101), np.zeros(101))
    for _ in range(2000):
        at = np.append(np.unique(rng.integers(0, 100, 8)), 100)
        model.learn(at, int(7 in at))
    w = model.weights(np.arange(101))
    assert w[7] > 2 and w[100] < 0 and (w[:100] != 0).sum() < 60


def test_dictionary_difference_prefers_its_own():
    good = [b"the quick brown fox %d jumps over" % k for k in range(200)]
    bad = [b"BUY!! NOW!! %d CHEAP!!" % k for k in range(200)]
    g, b = Q.sizer(Q.dictionary(good)), Q.sizer(Q.dictionary(bad))
    assert Q.difference(b"the quick brown fox jumps", g, b) > 0 > Q.difference(b"BUY!! CHEAP!! NOW!!", g, b)
    assert Q.difference(b"", g, b) == 0


def test_dictionaries_learn_from_whole_texts(spark):
    rng = np.random.default_rng(3)
    header = "this line of licence opens every document of the source alike. " * 10
    kinds = [["".join(rng.choice(list("abcdefghijklmnop"), 12)) for _ in range(40)] for _ in range(2)]
    rows = [(k, header + " ".join(rng.choice(kinds[k % 2], 60)), k % 2) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id bigint, quality int, toxic int")
    assert len(header) > Q.PIECE
    found = {r["doc_id"]: r["score"] for r in Q.quality(docs, labels).where("held_out").collect()}
    assert len(found) > 50
    assert min(v for k, v in found.items() if k % 2) > 0.9 and max(v for k, v in found.items() if not k % 2) < 0.1
