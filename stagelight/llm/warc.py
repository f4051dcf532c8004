"""WARC (7): seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with the WARC/1.1
records of one or more pages up to about ``FRAME_BYTES``, and ends with a seek
table as the Zstandard seekable format has it: a skippable frame with the
compressed and decompressed size of every frame and a footer that is found from
the end of the file. The manifest, a written table, maps each record identifier
to its bundle, frame, offset in the frame and length, so one record is read by
decompressing one frame.

Of records with equal payloads of at least ``REVISIT_BYTES`` that with the
smallest page_id is the response; the others are revisit records without payload
that refer to it.

Defined results
* null html is an empty payload; null urls leave out the target URI.
* Rows with null page_id are responses. Repeated rows of one page_id and payload
  are separate records of the same type; of equal payloads all rows with the
  smallest page_id are responses.
* An empty table writes no bundle and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, filesystem, partitions, shared_dir, text_slices, written

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
REVISIT_BYTES = 100
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed by the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "record_id string, page_id bigint, bundle string, frame int, offset bigint, length bigint"


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>",
                  f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at ``at``, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4:end + 4 + int(headers["Content-Length"])]
    return headers, block[block.index(b"\r\n\r\n") + 4:], end + 8 + len(block)


class BundleWriter:
    """Writes records into frames; keeps one frame and the seek table."""

    def __init__(self, out):
        self.out, self.frames, self.held, self.size = out, [], bytearray(), 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset in it of what is added."""
        if self.held and len(self.held) + len(data) > FRAME_BYTES:
            self._flush()
        place = len(self.frames), len(self.held)
        self.held += data
        return place

    def _flush(self) -> None:
        frame = self.compressor.compress(bytes(self.held))
        self.out.write(frame)
        self.frames.append((len(frame), len(self.held)))
        self.size += len(frame)
        self.held = bytearray()

    def close(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads the seek table, then any frame."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        table = self._read(size - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, full = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, full))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        at, packed, full = self.frames[k]
        return self.decompressor.decompress(self._read(at, packed), max_output_size=full)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        headers, payload, _ = parse(self.frame(frame), offset)
        return headers, payload


def revisits(pages: DataFrame, folder: str) -> DataFrame:
    """page_id, digest and refers_to of every revisit."""
    stamped = written(pages.select("page_id", _digest().alias("digest"), F.octet_length(_html()).alias("n"))
                      .where((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull()), folder, "stamped")
    groups = written(stamped.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("w"))
                     .where("w > 1"), folder, "groups")
    return (attach(stamped, groups, "digest", "w", stamped.count()).where("page_id <> refers_to")
            .select("page_id", "digest", "refers_to").distinct())


def _html():
    return F.coalesce(F.col("html"), F.lit(""))


def _digest():
    return F.sha2(_html().cast("binary"), 256)


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages' records below ``folder``; returns the written manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(f"{base}/bundles", recursive=True)
        writer = name = None
        for part, payloads in text_slices(batches, column="html"):
            columns = {c: part.column(part.schema.get_field_index(c)).to_pylist()
                       for c in ("page_id", "url", "digest", "refers_to")}
            rows = []
            for k, payload in enumerate(payloads):
                if writer is None or writer.size > BUNDLE_BYTES:  # each attempt writes files of its own names
                    if writer is not None:
                        writer.close()
                    name = f"bundles/{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
                page, digest = columns["page_id"][k], columns["digest"][k]
                data = record(page, columns["url"][k], payload, columns["refers_to"][k], digest)
                frame, offset = writer.add(data)
                rows.append((record_id(page, digest), page, name, frame, offset, len(data)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                ["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    own = pages.select("page_id", "url", "html", _digest().alias("digest"))
    own = own.join(revisits(pages, folder), ["page_id", "digest"], "left").select(
        "page_id", "url", "html", "digest", "refers_to")
    return written(own.mapInArrow(run, MANIFEST), folder, "manifest")


def read_bundles(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads all bundles back; per record: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A response whose payload is not what it says fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f:
                    reader = BundleReader(f)
                    for k in range(len(reader.frames)):
                        rows, data, at = [], reader.frame(k), 0
                        while at < len(data):
                            headers, payload, at = parse(data, at)
                            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                            n, kind = int(headers["X-Payload-Length"]), headers["WARC-Type"]
                            if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                                raise ValueError(f"{headers['WARC-Record-ID']}: payload and digest differ")
                            page, to = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                            rows.append((page and int(page), n, digest, kind, to and int(to)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), (
                                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # dealt in turn: by a key Spark would take the distinct's own partitions, and merge small ones
    bundles = manifest.select("bundle").distinct().repartition(partitions(manifest.sparkSession))
    return bundles.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, "
                                   "record_type string, refers_to bigint")


def read_record(folder: str, bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, by its row of the manifest."""
    fs, base = filesystem(folder)
    with fs.open_input_file(f"{base}/{bundle}") as f:
        return BundleReader(f).record(frame, offset)


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    return read_bundles(write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""
