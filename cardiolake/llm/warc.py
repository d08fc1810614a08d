"""Operator 8 - WARC records in seekable Zstandard bundles.

A bundle is a row (name, content) of a written table, so any file system Spark
can write to will hold it and a retried task leaves no half-written file;
``export_bundles`` turns rows into files.  Layout of ``content``:

* data frames: independent Zstandard frames, each of whole WARC/1.1 records;
* one skippable frame (magic 0x184D2A50): the index, compressed JSON that maps a
  record id to [frame, offset inside the decompressed frame, length];
* one skippable frame (magic 0x184D2A5E): the seek table of the public
  "seekable format" - compressed and decompressed size per frame, then the
  frame count, a descriptor byte and the magic 0x8F92EAB1.

So one record is read by seeking to the end, then to one frame.  Of records with
equal payloads of at least ``least_bytes`` the smallest page_id is written as
``response`` and the others as ``revisit`` with no payload.

Scale: digests are grouped with partial aggregation (a hot payload is one row
per task); only groups of two or more are joined back.  A task holds one bundle
of at most ``bundle_bytes`` compressed bytes plus one frame.

Defined results: a null html is an empty payload; repeated page_ids are written
as separate records (those that repeat the smallest id are responses too); a null page_id sorts after all others; an empty
table gives no bundle; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values of the public Zstandard seekable format.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BUNDLE_SCHEMA = "name string, records long, content binary"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame int, offset long"


def record_id(page_id: int | None, url: str | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}|{kind}')}>"


def target_uri(url: str | None) -> str:
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, first_url: str | None, is_revisit: bool) -> tuple[str, bytes]:
    """(record id, one WARC record); a revisit names the response ``refers_to`` of address ``first_url``."""
    kind = "revisit" if is_revisit else "response"
    rid = record_id(page_id, url, digest, kind)
    uri = target_uri(url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {rid}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Page-Url: {'null' if url is None else json.dumps(url)}",
    ]
    if is_revisit:
        head += [
            f"WARC-Profile: {IDENTICAL}",
            f"WARC-Refers-To: {record_id(refers_to, first_url, digest, 'response')}",
            f"WARC-Refers-To-Target-URI: {target_uri(first_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page: {'' if refers_to is None else refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """(headers, HTTP head, payload, end) of the record that starts at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start, n = end + 4, int(headers["Content-Length"])
    block = raw[start : start + n]
    http = block.index(b"\r\n\r\n") + 4
    return headers, block[:http], block[http:], start + n + 4


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frame_bytes = frame_bytes
        self.open, self.open_size, self.frames, self.sizes, self.index, self.size = [], 0, [], [], {}, 0

    def add(self, rid: str, record: bytes) -> None:
        self.index.setdefault(rid, []).append((len(self.frames), self.open_size, len(record)))
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.pack(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        index = self.pack(json.dumps(self.index, separators=(",", ":")).encode())
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        sizes = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, FOOTER_MAGIC)
        return b"".join(self.frames) + index + struct.pack("<II", SEEK_MAGIC, len(table)) + table


class BundleReader:
    """Random access to a bundle by frame or by record id."""

    def __init__(self, content: bytes):
        import zstandard

        self.content, self.unpack = content, zstandard.ZstdDecompressor().decompress
        n, _, magic = struct.unpack("<IBI", content[-9:])
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table")
        at, self.frames = 0, []
        for i in range(n):
            packed, plain = struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - i))
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return self.unpack(self.content[at : at + packed], max_output_size=plain)

    def index(self) -> dict[str, list]:
        at, packed, _ = self.frames[-1]
        return json.loads(self.unpack(self.content[at + 8 : at + packed]))

    def record(self, rid: str) -> bytes:
        frame, offset, n = self.index()[rid][0]
        return self.frame(frame)[offset : offset + n]

    def records(self) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
        """(frame, offset, headers, HTTP head, payload) of all records."""
        for i in range(len(self.frames) - 1):
            raw, at = self.frame(i), 0
            while at < len(raw):
                headers, http, payload, end = parse_record(raw, at)
                yield i, at, headers, http, payload
                at = end


def _bundles(frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task, made, writer, count = (context.partitionId() if context else 0), 0, BundleWriter(frame_bytes, level), 0

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([f"part-{task:06d}-{made:05d}.warc.zst"]), pa.array([count], pa.int64()), pa.array([writer.finish()], pa.binary())], names=["name", "records", "content"]
            )

        for batch in batches:
            for page_id, url, html, digest, refers_to, first_url, is_revisit in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(*record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, first_url, is_revisit))
                count += 1
                if writer.size >= bundle_bytes:
                    yield close()
                    made, writer, count = made + 1, BundleWriter(frame_bytes, level), 0
        if count:
            yield close()

    return run


def write_bundles(pages: DataFrame, least_bytes: int = 100, frame_bytes: int = 1 << 18, bundle_bytes: int = 4 << 20, level: int = 6) -> DataFrame:
    """(name, records, content): the archives of ``pages``, written once."""
    scratch = Scratch(pages.sparkSession, "warc", pages)
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(payload.cast("binary"), 256)).withColumn("big", F.octet_length(payload) >= least_bytes)
    groups = scratch.save(base.where("big").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("r")).where("n > 1").select("digest", F.col("r.page_id").alias("first"), F.col("r.url").alias("first_url")), "groups")
    marked = base.join(groups, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)) & F.col("big"))
    return scratch.save(
        marked.select(F.col("page_id").cast("long"), "url", "html", "digest", F.when(F.col("revisit"), F.col("first")).cast("long").alias("refers_to"), F.col("first_url").cast("string").alias("first_url"), "revisit").mapInArrow(
            _bundles(frame_bytes, bundle_bytes, level), BUNDLE_SCHEMA
        ),
        "bundles",
        wide=True,
    )


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per record found in the archives; see ``READ_SCHEMA``.

    The payload size and digest of a response come from the payload itself;
    those of a revisit from its headers.
    """
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for frame, offset, h, http, payload in BundleReader(content.as_py()).records():
                    revisit = h["WARC-Type"] == "revisit"
                    size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0]) if revisit else len(payload)
                    digest = h["WARC-Payload-Digest"].split(":")[1] if revisit else hashlib.sha256(payload).hexdigest()
                    refers = h.get("X-Refers-To-Page")
                    rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, json.loads(h["X-Page-Url"]), size, digest, h["WARC-Type"], int(refers) if refers else None, h["WARC-Record-ID"], name, frame, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return bundles.select("name", "content").mapInArrow(run, READ_SCHEMA)


def export_bundles(bundles: DataFrame, folder: str) -> list[str]:
    """Write the bundles as files into a folder of the driver; returns their paths."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in bundles.select("name", "content").toLocalIterator():
        path = os.path.join(folder, row["name"])
        with open(path + ".tmp", "wb") as f:
            f.write(row["content"])
        os.replace(path + ".tmp", path)
        out.append(path)
    return out


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: write all pages to archives and read them back."""
    bundles = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= 100
"""
