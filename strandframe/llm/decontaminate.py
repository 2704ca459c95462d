"""Benchmark decontamination with one FM-index per training shard.

A shard is a slice of an Arrow batch (about 2 MB of text). Its words become
integers: words that occur in no test phrase cannot be part of a hit, so only
runs of test-vocabulary words that are at least as long as the shortest phrase
are kept; they are joined with a separator and indexed. All phrases are then
searched backward at once through the ranks of a wavelet matrix over the
Burrows-Wheeler transform, their rows located by sampled suffix positions, and
the hits of a document merged into spans.

Phrases: every window of ``window`` consecutive words of an item, or all words
of an item that has fewer. Null or wordless items and documents give no hits
and no spans; repeated rows are judged alike; an empty table gives no rows;
only ``doc_id``/``item_id`` and ``text`` are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import textvec as tv

WINDOW = 10
#: Bytes of benchmark text in one broadcast block; a larger benchmark makes more blocks.
BLOCK_BYTES = 16 << 20
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = fresh
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Counts and locates integer phrases in an integer text (symbols from 1 on)."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.concatenate((text.astype(np.int64), [0]))
        self.n, self.sample = len(text), sample
        order = suffix_array(text)
        bwt = text[order - 1]
        sigma = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.ones, self.zeros = [], []
        level = bwt
        self.depth = max(1, int(sigma - 1).bit_length())
        for bit in range(self.depth - 1, -1, -1):
            on = (level >> bit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(on))))
            self.zeros.append(int(len(on) - on.sum()))
            level = np.concatenate((level[on == 0], level[on == 1]))
        marked = order % sample == 0
        self.marked = marked
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.positions = order[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first ``at`` entries of the transform."""
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            on = (symbol >> (self.depth - 1 - k)) & 1 == 1
            low = np.where(on, zeros + ones[low], low - ones[low])
            high = np.where(on, zeros + ones[high], high - ones[high])
        return high - low

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        symbol, at = np.zeros_like(row), row
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            on = ones[at + 1] - ones[at]
            symbol = symbol * 2 + on
            at = np.where(on == 1, zeros + ones[at], at - ones[at])
        return self.before[symbol] + self.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, given as the rows of a matrix."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            known = symbol < len(self.before) - 1
            symbol = np.where(known, symbol, 0)
            low = self.before[symbol] + self.rank(symbol, low)
            high = np.where(known, self.before[symbol] + self.rank(symbol, high), low)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled position."""
        found = np.full(len(rows), -1, np.int64)
        steps = 0
        open_, row = np.arange(len(rows)), rows
        while len(open_):
            hit = self.marked[row]
            found[open_[hit]] = self.positions[self.marks[row[hit]]] + steps
            open_, row = open_[~hit], row[~hit]
            if len(row):
                row = self._back(row)
            steps += 1
        return found


class Phrases:
    """The distinct test phrases of one block of items, as vocabulary numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        blob = [(text or "").encode() for _, text in items]
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in blob]))).astype(np.int64)
        w = tv.words(np.frombuffer(b"".join(blob), np.uint8), offsets, tv.ALNUM, tv.FOLD)
        self.vocabulary = np.unique(w.hash)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary & tv.U64(0xFFFF)).astype(np.int64)] = True
        ids = np.searchsorted(self.vocabulary, w.hash) + 2
        found: dict[bytes, set[int]] = {}
        for item in range(len(items)):
            own = ids[w.first[item] : w.first[item + 1]]
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if size else 0):
                found.setdefault(own[k : k + size].tobytes(), set()).add(item)
        by_size: dict[int, list[tuple[np.ndarray, list[int]]]] = {}
        for key, who in found.items():
            phrase = np.frombuffer(key, ids.dtype)
            by_size.setdefault(len(phrase), []).append((phrase, sorted(who)))
        self.groups = [(size, np.array([p for p, _ in got]), [who for _, who in got]) for size, got in sorted(by_size.items())]
        self.shortest = min(by_size, default=0)

    def hits(self, w: tv.Words) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[list[int]]]]:
        """By phrase length: word positions in the slice, the phrase at each, the length, and each phrase's items."""
        if not self.groups:
            return
        ids = np.zeros(len(w.hash), np.int64)
        maybe = np.flatnonzero(self.near[(w.hash & tv.U64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash[maybe]), len(self.vocabulary) - 1)
        ids[maybe] = np.where(self.vocabulary[at] == w.hash[maybe], at + 2, 0)
        row = w.rows()
        known = ids > 0
        same = np.zeros(len(ids), bool)
        same[1:] = known[1:] & known[:-1] & (row[1:] == row[:-1])
        begin = np.flatnonzero(known & ~same)
        follows = np.append(same[1:], False) if len(same) else same
        size = np.flatnonzero(known & ~follows) + 1 - begin
        keep = size >= self.shortest
        begin, size = begin[keep], size[keep]
        if not len(begin):
            return
        place = np.repeat(begin, size + 1) + tv.spread(size + 1)
        ends = np.cumsum(size + 1) - 1
        text = ids[np.minimum(place, len(ids) - 1)]
        text[ends] = 1
        index = FMIndex(text)
        for _, phrases, owners in self.groups:
            low, high = index.search(phrases)
            found = high - low
            rows = np.repeat(low, found) + tv.spread(found)
            yield place[index.locate(rows)], np.repeat(np.arange(len(phrases)), found), phrases.shape[1], owners


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of the items, each of a bounded size, however large the benchmark is."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null and item is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = int(size // block_bytes) + 1
    out = []
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        rows = sorted((r["item"], r["text"]) for r in block.collect())
        out.append(spark.sparkContext.broadcast(Phrases(rows, window)))
    return out


SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, cut: bool = False) -> DataFrame:
    """Per document: number of words, hit words, items found, and merged byte spans.

    ``keep`` names columns to carry along unchanged; with ``cut`` the result is
    those columns with the spans taken out of ``text``, without documents of
    which no word is left.
    """
    blocks = _blocks(benchmark, window, block_bytes)
    keep = keep or []
    if cut:
        shape = documents.select(*keep).schema
        source = documents.select(*keep)
    else:
        source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        shape = source.sparkSession.createDataFrame([], SCHEMA).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches):
            buf, offsets = tv.utf8(part.column("text"))
            w = tv.words(buf, offsets, tv.ALNUM, tv.FOLD)
            n = len(w.hash)
            depth = np.zeros(n + 1, np.int64)
            row = w.rows()
            items: dict[int, set[str]] = {}
            for block in blocks:
                phrases = block.value
                for at, which, size, owners in phrases.hits(w):
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + size, -1)
                    for r, k in set(zip(row[at].tolist(), which.tolist(), strict=True)):
                        items.setdefault(r, set()).update(phrases.names[o] for o in owners[k])
            hit = np.cumsum(depth[:-1]) > 0
            joined = np.zeros(n, bool)
            joined[1:] = hit[1:] & hit[:-1] & (row[1:] == row[:-1])
            begin = np.flatnonzero(hit & ~joined)
            end = np.flatnonzero(hit & ~np.append(joined[1:], [False] * (n > 0)))
            spans: dict[int, list[tuple[int, int]]] = {}
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                r = int(row[b])
                spans.setdefault(r, []).append((int(w.start[b] - offsets[r]), int(w.end[e] - offsets[r])))
            hits = tv.sums(hit, w.first)
            if cut:
                yield _without(part, buf, offsets, spans, w.counts - hits, hits)
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(hits),
                    pa.array([sorted(items.get(r, ())) for r in range(part.num_rows)], pa.list_(pa.string())),
                    pa.array([[{"start": s, "end": e} for s, e in spans.get(r, ())] for r in range(part.num_rows)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return source.mapInArrow(scan, shape)


def _without(part: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, spans: dict, left: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    texts = part.column("text").to_pylist()
    for r, cuts in spans.items():
        raw, at, kept = buf[offsets[r] : offsets[r + 1]].tobytes(), 0, []
        for s, e in cuts:
            kept.append(raw[at:s])
            at = e
        texts[r] = b"".join([*kept, raw[at:]]).decode()
    columns = [pa.array(texts, c.type) if name == "text" else c for name, c in zip(part.schema.names, part.columns, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array((hits == 0) | (left > 0)))



def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; ``n_chars`` follows the text."""
    cleaned = find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=docs.columns, cut=True)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned
