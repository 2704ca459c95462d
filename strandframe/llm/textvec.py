"""Vectorised tokenising and hashing of UTF-8 text held in Arrow buffers.

Every text of a slice is scanned as one byte array: word borders come from a
256-entry table. A word's 64-bit hash is the mixed sum of one random number for
each byte and its place in the word (tabulation hashing); words of more than
``PLACES`` bytes are hashed by keyed BLAKE2b. Neither has the structural
collisions of a polynomial modulo 2**64. Phrases of words are hashed by
doubling, each step mixed. No Python object is made per word, long ones
excepted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
SLICE_BYTES = 2 << 20
PIECE_BYTES = 1 << 20


def _table(inside: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


#: Words between ASCII white space.
SPACED = ~_table([0x20, *range(0x09, 0x0E)])
#: Words of ASCII digits and letters and of anything beyond ASCII.
ALNUM = _table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Bytes of a word that have numbers of their own, and these numbers.
PLACES = 64
_NUMBERS = [mix(np.arange(PLACES * 256, dtype=np.uint64) * U64(2) + U64(seed)) for seed in (BASE, BASE2)]
_KEYS = [seed.to_bytes(8, "little") for seed in (BASE, BASE2)]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that a slice has about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: byte ranges, hashes, the first word of each row, and second hashes if asked for."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    hash2: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """How many words the row still has from each word on, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))


def _cut(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, at: int, most: int) -> int:
    """The end of a piece that begins at ``at``: no word goes on beyond it."""
    end, n = at + most, len(buf)
    if end >= n:
        return n
    k = int(np.searchsorted(offsets, end, side="right")) - 1
    border = int(offsets[k]) if offsets[k] > at else at
    gaps = np.flatnonzero(~inside[buf[max(at, border) : end]])
    if len(gaps):
        return max(at, border) + int(gaps[-1]) + 1
    if border > at:
        return border
    step = most
    while True:  # one word longer than a piece
        nxt = int(offsets[k + 1])
        stop = min(end + step, n, nxt)
        gaps = np.flatnonzero(~inside[buf[end:stop]])
        if len(gaps):
            return end + int(gaps[0]) + 1
        if stop in (n, nxt):
            return stop
        end = stop


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED, fold: np.ndarray | None = None, second: bool = False) -> Words:
    """The words of a slice. ``second`` fills ``Words.hash2`` too, 64 more bits that do not depend on the first."""
    starts, ends, hashes = [], [], ([], [])
    at, n = 0, len(buf)
    while at < n:
        stop = _cut(buf, offsets, inside, at, PIECE_BYTES)
        part = buf[at:stop]
        m = inside[part]
        borders = offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, stop, side="left")] - at
        before = np.empty_like(m)
        before[0] = False
        before[1:] = m[:-1]
        before[borders] = False
        after = np.empty_like(m)
        after[-1] = False
        after[:-1] = m[1:]
        after[borders - 1] = False
        first = m & ~before
        s, e = np.flatnonzero(first), np.flatnonzero(m & ~after) + 1
        index = np.arange(len(part), dtype=np.int32)
        place = np.minimum(index - np.maximum.accumulate(np.where(first, index, 0)), PLACES - 1)
        seen = part if fold is None else fold[part]
        entry = (place << 8) | seen
        long = np.flatnonzero(e - s > PLACES)
        for k in range(1 + second):
            acc = np.zeros(len(part) + 1, U64)
            np.cumsum(_NUMBERS[k][entry], out=acc[1:])
            own = mix(acc[e] - acc[s])
            for j in long.tolist():
                own[j] = int.from_bytes(hashlib.blake2b(seen[s[j] : e[j]], digest_size=8, key=_KEYS[k]).digest(), "little")
            hashes[k].append(own)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    one, two = (np.concatenate(h) if h else np.zeros(0, U64) for h in hashes)
    return Words(start, end, one, np.searchsorted(start, offsets, side="left"), two if second else None)


def ngrams(hashes: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Hash of the n hashes from each position on; rows are not looked at."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out, done, block, size = None, 0, hashes, 1
    while True:
        if n & size:
            out = block[:m] if out is None else mix(out * U64(base) + block[done : done + m])
            done += size
        if done == n:
            return mix(out ^ U64(base)) if n == 1 else out
        block = mix(block[:-size] * U64(base) + block[size:])
        size *= 2


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the groups with these sizes."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values in each range first[i]:first[i+1]."""
    acc = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=acc[1:])
    return acc[first[1:]] - acc[first[:-1]]
