from __future__ import annotations

import hashlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
import zstandard

from stagelight.llm import warc as W
from stagelight.llm.common import shared_dir

from .conftest import SF, as_rows

SCHEMA = "page_id bigint, url string, html string, digest string, w int, n string, bundle int"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>é😀</p>" * 200_000
    rows = [(0, "http://a/", None), (1, None, ""), (2, "u\r\nX: y", "x" * 99), (3, "u", "x" * 99), (4, "é", "y" * 100),
            (9, "u", "y" * 100), (5, "u", "y" * 100), (6, "u", long), (7, "u", long), (None, "u", "y" * 100), (4, "u", "y" * 100),
            (8, "u", "WARC/1.1\r\n\r\n" * 50)]
    return spark.createDataFrame([(*r, "d", 1, None, 2) for r in rows], SCHEMA)


def brute(rows):
    first, out = {}, []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        to = first.get(data) if i is not None else None
        revisit = to is not None and to != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def read_back(pages):
    folder = shared_dir(pages.sparkSession)
    return W.read_bundles(W.write_bundles(pages, folder), folder)


def test_odd_pages(spark, pages):
    assert as_rows(read_back(pages)) == brute([tuple(r) for r in pages.collect()])
    assert read_back(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert as_rows(read_back(pages)) == brute([tuple(r) for r in pages.collect()])


def test_manifest_finds_each_record(spark, pages):
    folder = shared_dir(spark)
    for row in W.write_bundles(pages, folder).collect():
        headers, payload = W.read_record(folder, row["bundle"], row["frame"], row["offset"])
        assert headers["WARC-Record-ID"] == f"<{row['record_id']}>"
        assert headers.get("X-Page-Id") == (None if row["page_id"] is None else str(row["page_id"]))
        if headers["WARC-Type"] == "response":
            assert headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        else:
            assert payload == b"" and "WARC-Refers-To" in headers


def test_bundle_is_plain_zstandard_and_has_a_seek_table(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FRAME_BYTES", 1000)
    fs, path = pafs.LocalFileSystem(), f"{tmp_path}/b.warc.zst"
    writer = W.BundleWriter(fs.open_output_stream(path, compression=None))
    records = [W.record(k, "u", b"p" * n, None, "0") for k, n in enumerate((10, 5000, 0, 700, 900))]
    places = [writer.add(r) for r in records]
    writer.close()
    data = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(records)  # readers that know no seek table skip it
    reader = W.BundleReader(fs.open_input_file(path))
    assert len(reader.frames) == 5 and [f for f, _ in places] == sorted(f for f, _ in places)
    for (frame, offset), record in zip(places, records):
        assert reader.frame(frame)[offset:offset + len(record)] == record
    with pytest.raises(ValueError):
        open(f"{tmp_path}/x", "wb").write(b"no table here, only text")
        W.BundleReader(fs.open_input_file(f"{tmp_path}/x"))


def test_bundles_are_read_by_many_tasks(spark):
    """Eight bundles, one for each writing task, are dealt over the tasks that read."""
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 30) for k in range(400)], "page_id bigint, url string, html string")
    folder = shared_dir(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = W.write_bundles(pages, folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert manifest.select("bundle").distinct().count() >= 8
    back = W.read_bundles(manifest, folder)
    sizes = back.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 3 and sum(r["count"] for r in sizes) == 400
