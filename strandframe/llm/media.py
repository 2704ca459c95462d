"""Payloads in MPEG transport streams (ISO/IEC 13818-1).

``mux`` writes a PAT, a PMT and one elementary stream of private data (stream
type 0x06, stream id 0xBD): the payload is cut into PES packets, each with a
90 kHz presentation time stamp, its first transport packet marked as a
random-access point and carrying a program clock reference. ``demux`` reads
the tables of all programs (with their CRC-32/MPEG-2), follows the continuity
counters of every PID (copies, packets without payload and discontinuity flags
allowed for), puts the elementary packets together again and lists time stamps
with the packet numbers of their random-access points. The streams are stored
as a column of Parquet files and read from there in a step of its own.

A null or empty text has the payload of 64 zero bytes; equal texts have equal
streams; repeated rows are treated alike; an empty table gives no rows; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table
from . import textvec as tv

PACKET = 188
SYNC = 0x47
PMT_PID, DATA_PID = 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Bytes of payload in one PES packet, and 90 kHz ticks from one to the next.
PES_BYTES, TICKS = 32_000, 3_600


def _crc_table() -> list[int]:
    table = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[(c >> 24) ^ b]
    return c


def _section(pid: int, body: bytes) -> bytes:
    body += crc_mpeg(body).to_bytes(4, "big")
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + body).ljust(PACKET, b"\xff")


_PAT = _section(0, bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
_PMT = _section(PMT_PID, bytes([0x02, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 30 & 7) << 1, ticks >> 22 & 0xFF, 1 | (ticks >> 15 & 0x7F) << 1, ticks >> 7 & 0xFF, 1 | (ticks & 0x7F) << 1])


def _ticks(raw: bytes) -> int:
    return (raw[0] >> 1 & 7) << 30 | raw[1] << 22 | (raw[2] >> 1) << 15 | raw[3] << 7 | raw[4] >> 1


def mux(payload: bytes) -> bytes:
    out, counter = [_PAT, _PMT], 0
    for number, at in enumerate(range(0, len(payload), PES_BYTES)):
        chunk = payload[at : at + PES_BYTES]
        pts = number * TICKS & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + chunk
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        # first packet: adaptation field of 8 bytes at least (flags, clock reference)
        room = PACKET - 4 - 8
        first, rest = pes[:room], pes[room:]
        field = bytes([7 + room - len(first), 0x50]) + clock + b"\xff" * (room - len(first))
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]) + field + first)
        counter = counter + 1 & 15
        full, tail = divmod(len(rest), PACKET - 4)
        if full:
            body = np.empty((full, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            body[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            body[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(body.tobytes())
            counter = counter + full & 15
        if tail:
            spare = PACKET - 4 - tail  # one byte or more of adaptation field
            field = bytes([spare - 1]) + (b"\x00" + b"\xff" * (spare - 2) if spare > 1 else b"")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]) + field + rest[-tail:])
            counter = counter + 1 & 15
    return b"".join(out)


class StreamError(ValueError):
    """A transport stream that does not follow its own tables or counters."""


def _table(packet: np.ndarray, kind: int) -> bytes:
    raw = packet.tobytes()
    at = 5 + raw[4]
    size = 3 + ((raw[at + 1] & 0x0F) << 8 | raw[at + 2])
    body = raw[at : at + size]
    if body[0] != kind or crc_mpeg(body):
        raise StreamError(f"table {kind} is broken")
    return body[:-4]


def _followed(own: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets of one PID carry new payload, and how often its counter breaks.

    The counter steps by one with each payload and stays without one; one exact
    copy of a packet may follow it; a set discontinuity flag excuses a step.
    """
    counter, loaded = own[:, 3] & 15, own[:, 3] & 0x10 != 0
    excused = (own[:, 3] & 0x20 != 0) & (own[:, 4] > 0) & (own[:, 5] & 0x80 != 0)
    copy = np.zeros(len(own), bool)
    copy[1:] = loaded[1:] & (counter[1:] == counter[:-1]) & (own[1:] == own[:-1]).all(1)
    copy[1:] &= ~copy[:-1]
    step = (counter[1:] - counter[:-1]) & 15
    broken = (step != np.where(loaded[1:] & ~copy[1:], 1, 0)) & ~excused[1:]
    return loaded & ~copy, int(broken.sum())


def _elementary(own: np.ndarray, number: np.ndarray) -> tuple[list[bytes], list[int], list[int], int]:
    """Whole elementary packets of a PID, their time stamps, its random-access points, and how many packets are cut."""
    adapted = own[:, 3] & 0x20 != 0
    skip = np.minimum(4 + np.where(adapted, own[:, 4].astype(np.int64) + 1, 0), PACKET)
    flags = np.where(adapted & (own[:, 4] > 0), own[:, 5], 0)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    data = own[np.arange(PACKET)[None, :] >= skip[:, None]].tobytes()
    at = np.concatenate(([0], np.cumsum(PACKET - skip)))
    chunks, stamps, cut = [], [], int(len(starts) == 0 or starts[0] > 0) if len(own) else 0
    for k, s in enumerate(starts):
        end = at[starts[k + 1]] if k + 1 < len(starts) else at[-1]
        pes = data[at[s] : end]
        if pes[:3] != b"\x00\x00\x01" or len(pes) != int.from_bytes(pes[4:6], "big") + 6:
            cut += 1
            continue
        stamps.append(_ticks(pes[9:14]))
        chunks.append(pes[9 + pes[8] :])
    return chunks, stamps, number[(flags & 0x40) != 0].tolist(), cut


def demux(stream: bytes, strict: bool = True) -> tuple[bytes, dict]:
    """The payload of the first private-data stream, and what the transport stream says of itself.

    All programs of the PAT are read. The counters of every PID but that of
    null packets are followed; breaks and cut elementary packets are counted,
    and with ``strict`` they are an error. Broken tables always are.
    """
    if not stream or len(stream) % PACKET:
        raise StreamError("not a whole number of packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise StreamError("sync byte missing")
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    errors, kept = 0, {}
    for p in np.unique(pid).tolist():
        if p != 0x1FFF:
            number = np.flatnonzero(pid == p)
            new, broken = _followed(packets[number])
            kept[p], errors = number[new], errors + broken
    if not len(kept.get(0, ())):
        raise StreamError("no program table")
    pat = _table(packets[kept[0][0]], 0)
    programs: dict[int, list[tuple[int, int]]] = {}
    for k in range(8, len(pat), 4):
        program, pmt_pid = pat[k] << 8 | pat[k + 1], (pat[k + 2] & 0x1F) << 8 | pat[k + 3]
        if program and len(kept.get(pmt_pid, ())):
            pmt = _table(packets[kept[pmt_pid][0]], 2)
            at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
            programs[program] = []
            while at < len(pmt):
                programs[program].append((pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]))
                at += 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])
    streams = [x for own in programs.values() for x in own]
    kind, es_pid = next((x for x in streams if x[0] == STREAM_TYPE), streams[0] if streams else (0, -1))
    number = kept.get(es_pid, np.zeros(0, np.int64))
    chunks, stamps, points, cut = _elementary(packets[number], number)
    if strict and (errors or cut):
        raise StreamError(f"{errors} breaks of continuity, {cut} elementary packets cut")
    return b"".join(chunks), {"packets": len(packets), "programs": programs, "stream_type": kind, "pts": stamps, "random_access": points, "continuity_errors": errors, "cut": cut}


def payload_of(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"
#: Bytes of streams in one Arrow batch.
BATCH_BYTES = 8 << 20


def store(documents: DataFrame) -> DataFrame:
    """doc_id, bytes of the text, and its transport stream (column ``media``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches):
            buf, offsets = tv.utf8(part.column("text"))
            media = [mux(payload_of(buf[offsets[r] : offsets[r + 1]].tobytes())) for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(scan, STORED)


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored streams hold: payload and stream digests, features, time stamps, random-access points.

    Breaks of continuity and cut packets are in ``feature``; they do not stop
    the job. A stream whose tables cannot be read has no payload and the
    feature ``unreadable``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches, "media", BATCH_BYTES):
            rows: list[tuple] = []
            for stream in part.column("media").to_pylist():
                stream = stream or b""
                try:
                    back, facts = demux(stream, strict=False)
                    pts, points = facts["pts"], facts["random_access"]
                    feature = f"packets={facts['packets']};type={facts['stream_type']};pes={len(pts)};pts={min(pts, default='')}-{max(pts, default='')};rap={','.join(map(str, points))};errors={facts['continuity_errors']}"
                    if facts["cut"]:
                        feature += f";cut={facts['cut']}"
                except StreamError:
                    back, pts, points, feature = b"", [], [], "unreadable"
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, pts, points))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            arrays = [part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [x.split()[0] for x in READ.split(", ")]
    return stored.mapInArrow(scan, READ)


def stored_and_read(documents: DataFrame) -> DataFrame:
    """Streams written to the shared folder (a column of Parquet files), and read from there."""
    return read_back(materialize(store(documents), "media", compression="zstd"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_and_read(read_table(spark, sf_dir, "documents")).drop("pts", "random_access")
