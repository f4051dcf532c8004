from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
import corpus_pipeline
from stagelight.llm.common import BATCH, BATCH_BYTES, written
from stagelight.llm.registry import ORACLE_SQL, QUERIES

from .brute import a_to_z, contamination, near_components, shingle_set
from .conftest import SF, texts
from .test_tokens_and_packing import check_pieces

SF01 = "/root/testdata/sf0.01"


def test_entry_has_them():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())
    assert [f"op{n}" for n in range(1, 14)] == sorted((k.split("_")[0] for k in QUERIES), key=lambda k: int(k[2:]))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF01)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]
    clean = stages["toxicity"](spark, docs, SF)
    unique = stages["exact_dedup"](spark, docs, SF)
    apart = stages["ngram_jaccard"](spark, docs, SF)
    fresh = stages["decontamination"](spark, docs, SF)
    for df in (clean, unique, apart, fresh):
        assert df.columns == docs.columns and set(texts(df)) <= set(texts(docs))
    known = texts(docs)
    last = {}
    for i, t in known:
        last[a_to_z(t)] = max(i, last.get(a_to_z(t), i))
    assert {i for i, _ in texts(unique)} == set(last.values())
    comp = near_components(known)
    assert {i for i, _ in texts(apart)} == {i for (i, s), c in comp.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, _ in texts(fresh)} == {i for i, t in known if not contamination(t, items)[4]}


def test_pipeline_runs_all_stages(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    known = dict(texts(spark.read.parquet(f"{SF}/documents.parquet")))
    kept = {r["doc_id"] for r in pieces}
    assert 0 < len(kept) < len(known)
    check_pieces([(i, known[i]) for i in kept], pieces, 1024)
    sets = [shingle_set(known[i]) for i in kept]
    assert len({a_to_z(known[i]) for i in kept}) == len(kept)
    for k, a in enumerate(sets):
        assert not any(a and 100 * len(a & b) >= 75 * len(a | b) for b in sets[:k])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, stage, odd, empty):
    for df in (odd, empty):
        out = stage(spark, df, SF)
        assert out.count() <= 10 * max(1, df.count()) * 20
        if stage is not corpus_pipeline.pack:
            assert out.columns == df.columns
        if df is empty:
            assert out.count() == 0


def test_intermediate_tables_need_no_buffer_of_a_page(spark, tmp_path):
    rows = spark.range(8, numPartitions=1).selectExpr("id", "repeat(cast(id as string), 1000000) AS data")
    again = written(rows, str(tmp_path), "rows")
    assert sorted((r["id"], len(r["data"])) for r in again.collect()) == [(i, 1_000_000) for i in range(8)]
    for file in (tmp_path / "rows").glob("*.parquet"):
        column = pq.ParquetFile(file).metadata.row_group(0).column(1)
        assert column.compression == "ZSTD"


def test_stages_hand_tasks_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["size"])

    before = spark.conf.get(BATCH)
    try:
        corpus_pipeline.prepare(spark)
        rows = spark.range(300, numPartitions=1).selectExpr("repeat('x', 100000) AS text")
        largest = max(r["size"] for r in rows.mapInArrow(sizes, "size bigint").collect())
    finally:
        spark.conf.set(BATCH, before)
    assert largest <= BATCH_BYTES + 200_000 and BATCH_BYTES <= 4 << 20
