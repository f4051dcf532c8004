from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from stagelight.llm import digest_index as D
from stagelight.llm.common import shared_dir

from .brute import a_to_z
from .conftest import as_rows, texts


def brute(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[a_to_z(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in set(ids)]
    return sorted(out, key=repr)


def test_odd_rows(odd):
    assert as_rows(D.decide(odd)) == brute(texts(odd))


def test_kept_rows_keep_one_of_each_and_all_columns(odd):
    kept = D.kept_rows(odd)
    assert kept.columns == odd.columns
    assert sorted((a_to_z(t) for _, t in texts(kept))) == sorted({a_to_z(t) for _, t in texts(odd)})
    assert {(i, t) for i, t in texts(kept)} <= {(i, t) for i, t in texts(odd)}


def test_empty(empty):
    assert D.decide(empty).count() == 0 and D.kept_rows(empty).count() == 0


def test_documents_and_rows_agree(documents):
    kept = {r["doc_id"] for r in D.decide(documents).where("kept").collect()}
    assert {r["doc_id"] for r in D.kept_rows(documents).select("doc_id").collect()} == kept


def test_batches_append_and_rerun(spark, documents):
    path = f"{shared_dir(spark)}/index"
    first, second = documents.where("doc_id % 3 <> 0"), documents
    index = D.DigestIndex(spark, path, buckets=4)
    one = as_rows(D.decide(first, index, "one"))
    again = D.DigestIndex(spark, path)  # opened anew, as in another session
    assert again.buckets == 4
    two = as_rows(D.decide(second, again, "two"))
    seen = {r[4]: r[1] for r in one}
    for doc_id, keep_id, _, kept, digest in two:
        if digest in seen:
            assert keep_id == seen[digest] and not kept
    assert {r[4] for r in two if r[3]} == {r[4] for r in two} - set(seen)
    assert as_rows(D.decide(second, again, "two")) == two  # a batch that runs again gives the same
    assert again.entries().groupBy("digest").count().where("count > 1").count() == 0


def test_index_is_joined_without_shuffling_it(spark, documents):
    index = D.DigestIndex(spark, f"{shared_dir(spark)}/index", buckets=8)
    D.decide(documents, index, "one").count()
    groups = documents.select(D.digest(F.col("text")).alias("digest"), F.col("doc_id").alias("keep_id"))
    plan = index.find(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1
