"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some records, with
a seek table in a skippable frame at its end (the public seekable format). The
index maps a record identifier to its bundle, frame and offset inside the
frame, so one record is read by decompressing one frame.

Records whose payloads are equal and have at least ``MIN_REVISIT`` bytes are
one ``response`` (that of the largest page_id) and ``revisit`` records that
refer to it and carry no payload. The heads of groups are found by a
pre-aggregated ``max`` on a SHA-256 key; only the key, never the html, is
grouped, and the join back may be split when one payload is very frequent.

Null html is an empty payload; a null page_id is kept, is the head of a group
only among others, and never referred to; rows with one page_id and one payload get the
same record type; an empty table gives no rows; only ``page_id``, ``url`` and
``html`` are read. A task that runs again writes bundles with other names, and
the index holds only those of the attempt that counted.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table, shared_dir
from . import textvec as tv

MIN_REVISIT = 1000
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
DATE = "2024-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "record_id string, page_id long, bundle string, frame long, offset long, size long"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as Spark writes it: s3a and s3n are s3; schemes that Arrow lacks are left to fsspec, where installed."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return pafs.FileSystem.from_uri(f"file://{uri}")
    if scheme in ("s3a", "s3n"):
        scheme, uri = "s3", f"s3:{rest}"
    if scheme in ("file", "s3", "gs", "gcs", "hdfs", "viewfs", "abfs", "abfss"):
        return pafs.FileSystem.from_uri(uri)
    import fsspec  # noqa: PLC0415  only for such schemes

    store, path = fsspec.core.url_to_fs(uri)
    return pafs.PyFileSystem(pafs.FSSpecHandler(store)), path


class BundleWriter:
    """Collects records into frames; ``close`` appends the seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame = bytearray()
        self.table: list[tuple[int, int]] = []
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame number, offset in the frame and size of the record."""
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self.flush()
        place = len(self.table), len(self.frame), len(record)
        self.frame += record
        return place

    def flush(self) -> None:
        packed = self.packer.compress(bytes(self.frame))
        self.stream.write(packed)
        self.table.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.frame.clear()

    def close(self) -> None:
        if self.frame:
            self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class BundleReader:
    """Reads frames of a bundle by its seek table; keeps the last frame."""

    def __init__(self, stream):
        self.stream, self.opener = stream, zstandard.ZstdDecompressor()
        end = stream.size()
        frames, flags, magic = struct.unpack("<IBI", stream.read_at(9, end - 9))
        if magic != _SEEKABLE or flags & 0x80:
            raise ValueError("no seek table")
        raw = stream.read_at(8 * frames, end - 9 - 8 * frames)
        self.sizes = np.frombuffer(raw, "<u4").reshape(-1, 2).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes[:, 0])))
        self.have = (-1, b"")

    def record(self, frame: int, offset: int, size: int) -> bytes:
        if self.have[0] != frame:
            packed = self.stream.read_at(int(self.sizes[frame, 0]), int(self.offsets[frame]))
            self.have = frame, self.opener.decompress(packed, max_output_size=int(self.sizes[frame, 1]))
        return self.have[1][offset : offset + size]


def warc_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def encode_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    uri = "".join(ch for ch in url or "" if ch not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {warc_id(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {warc_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def with_heads(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to (null for a response)."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = page.withColumn("key", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    heads = keyed.where("key is not null").groupBy("key").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    long = keyed.where("key is not null").join(heads, "key", "left").select("page_id", "url", "html", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")).alias("refers_to"))
    # short pages have no key and are not shuffled
    return long.union(keyed.where("key is null").select("page_id", "url", "html", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str, least: int = MIN_REVISIT) -> DataFrame:
    """Writes the bundles of ``pages`` to ``folder`` and returns the index, itself written down."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        bundle, name, rows = None, "", []
        for part in tv.slices(batches, "html"):
            buf, offsets = tv.utf8(part.column("html"))
            ids, urls, refs = (part.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for r in range(part.num_rows):
                if bundle is None or bundle.written > BUNDLE_BYTES:
                    if bundle:
                        bundle.close()
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
                record = encode_record(ids[r], urls[r], buf[offsets[r] : offsets[r + 1]].tobytes(), refs[r])
                rows.append((warc_id(ids[r]), ids[r], name, *bundle.add(record)))
            yield _rows(rows)
            rows = []
        if bundle:
            bundle.close()

    return materialize(with_heads(pages, least).mapInArrow(write, INDEX), "warc-index")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


READ = "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records named by the index, read from their frames; a payload that does
    not fit its digest is an error. The index lists a bundle's records together,
    so each frame is opened about once."""
    names = [x.split()[0] for x in READ.split(", ")][: None if with_payload else -1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        open_name, reader = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for x in batch.slice(at, 256).to_pylist():
                    if x["bundle"] != open_name:
                        open_name, reader = x["bundle"], BundleReader(fs.open_input_file(f"{base}/{x['bundle']}"))
                    fields, payload = decode_record(reader.record(x["frame"], x["offset"], x["size"]))
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Record-ID"] != x["record_id"] or kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"record {x['record_id']} is damaged")
                    refers = fields.get("X-Refers-To-Page")
                    rows.append((int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], kind, refers and int(refers), size, digest, payload)[: len(names)])
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return index.mapInArrow(read, READ if with_payload else READ.removesuffix(", payload binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT page_id, h, n, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND head <> page_id THEN head END AS refers_to
FROM g
"""
