"""Repeated passages: recurring windows are confirmed, compiled into sharded
Aho-Corasick automata, and located in all documents.

A window is ``WINDOW`` consecutive words. Words covered by a window whose word
sequence also starts earlier (smaller doc_id, or earlier in the document) are
removed; windows are judged on the input.

1. Confirm. Each window elects an anchor, the least of its word n-grams of
   ``GRAM`` words by hash; equal windows elect equal anchors. Anchors are
   counted with pre-aggregation, and those that occur twice enter a bitmap of
   bounded size. Windows with such an anchor are counted by a 128-bit hash of
   two independent halves, with their first occurrence; a saturated bitmap only
   lets more windows into this count. Windows counted twice are recurring.
2. Compile. First occurrences that follow one another make passages. A passage
   is sampled at every ``STEP`` words by a phrase of ``PHRASE`` words, so that
   each of its windows holds a phrase. Phrases, with the hashes of the words
   around them, are dealt by their hash to shards of about ``SHARD`` phrases; a
   shard's automaton is compiled in the task that reads it. Words are spelled
   with two letters each, so a phrase has a fixed length.
3. Stream. All documents are streamed past a bitmap of all phrases; where one
   may begin, inside a stretch of windows that can recur, its words and those
   around it are dealt to the phrase's shard. There the automaton locates the
   phrases, each is compared word by word with its surroundings, and windows
   inside the agreement are repeats unless they are the first occurrence itself.
   Phrases of windows with ``HOT`` occurrences or more are compiled in
   ``SALTS`` tasks each, among which their occurrences are dealt by document.
   The repeats found are joined to the documents.

Work and traffic are in proportion to the text; only bitmaps of bounded size
reach the driver. Null, empty and shorter texts have no windows and keep their
words; rows that repeat a doc_id with the same text are one occurrence (nothing
is removed on their account); of rows that give one doc_id several texts the
order is not defined; an empty table gives no rows; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, read_table
from . import bitmap as bitmaps
from . import textvec as tv

WINDOW, GRAM = 20, 9
PHRASE = 6
STEP = WINDOW - PHRASE + 1
REACH = WINDOW - PHRASE
SHARD = 4_000
HOT, SALTS = 256, 16
#: Bytes of text worked on at a time; all arrays of a step are some 30 times as large.
SLICE_BYTES = 1 << 20
LETTERS, FIRST_LETTER, GAP_LETTER = 2, 48, 33


def window_anchors(w: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the position of each one's anchor, and the n-gram hashes."""
    grams = tv.ngrams(w.hash, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    least, place, span = grams, np.arange(len(grams)), 1

    def join(step: int) -> None:
        nonlocal least, place
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])

    while span * 2 <= width:
        join(span)
        span *= 2
    if width > span:
        join(width - span)
    starts = np.flatnonzero(w.room()[: len(place)] >= WINDOW)
    return starts, place[starts], grams


def _anchors(source: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches, most=SLICE_BYTES):
            w = tv.words(*tv.utf8(part.column("text")))
            _, place, grams = window_anchors(w)
            chosen = np.zeros(len(grams), bool)
            chosen[place] = True
            yield pa.RecordBatch.from_arrays([pa.array(grams[chosen].view(np.int64))], names=["h"])

    return source.mapInArrow(scan, "h long")


def _recurring(source: DataFrame, bitmap) -> DataFrame:
    """doc and start of the first occurrence of each recurring window, and how many it has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches, most=SLICE_BYTES):
            w = tv.words(*tv.utf8(part.column("text")), second=True)
            starts, place, grams = window_anchors(w)
            starts = starts[bitmap.value.has(grams[place])]
            row = w.rows()[starts]
            one, two = tv.ngrams(w.hash, WINDOW)[starts], tv.ngrams(w.hash2, WINDOW, tv.BASE2)[starts]
            # one row for each window and document, with its least start there
            order = np.lexsort((starts, one, row))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
            head = np.flatnonzero(fresh)
            keep = order[head]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one[keep].view(np.int64)),
                    pa.array(two[keep].view(np.int64)),
                    pa.array(ids[row[keep]].astype(np.int64)),
                    pa.array(starts[keep] - w.first[row[keep]]),
                    pa.array(np.diff(np.append(head, len(order)))),
                ],
                names=["w1", "w2", "doc", "start", "n"],
            )

    windows = source.mapInArrow(scan, "w1 long, w2 long, doc long, start long, n long")
    counted = windows.groupBy("w1", "w2").agg(F.min("doc").alias("doc"), F.min_by("start", "doc").alias("start"), F.sum("n").alias("n"))
    return counted.where("n > 1").select("doc", "start", "n")


def spell(hashes: np.ndarray) -> np.ndarray:
    """Two letters of seven bits for each word, as rows of bytes."""
    shifts = np.array([57, 50], np.uint64)
    return ((hashes[:, None] >> shifts) & np.uint64(127)).astype(np.uint8) + np.uint8(FIRST_LETTER)


WIDTH = PHRASE + 2 * REACH
PLACE = ["doc", "at", "left", "right", "around"]
TILE = "doc long, at long, left int, right int, around binary, code long, n long"
DEALT = "shard long, kind int, doc long, at long, left int, right int, around binary"
_OFFSETS = np.arange(-REACH, PHRASE + REACH)


def _places(w: tv.Words, q: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Columns of PLACE for phrases at word positions q: the hashes of the words around them are 0 beyond left and right."""
    inside = (_OFFSETS >= -left[:, None]) & (_OFFSETS < PHRASE + right[:, None])
    around = np.where(inside, w.hash[np.clip(q[:, None] + _OFFSETS, 0, max(len(w.hash) - 1, 0))], 0) if len(q) else np.zeros((0, WIDTH), np.uint64)
    return [pa.array(doc), pa.array(at), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), _rows(around)]


def _deal(columns: list[pa.Array], shard: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(shard), kind, np.int32)), *columns], names=["shard", "kind", *PLACE])


def _shard(code: np.ndarray, salt: np.ndarray, shards: int) -> np.ndarray:
    return (tv.mix(code + np.uint64(1)) % np.uint64(shards)).astype(np.int64) * SALTS + salt


def _rows(table: np.ndarray) -> pa.Array:
    table = np.ascontiguousarray(table)
    width = table.shape[1] * table.itemsize
    offsets = pa.array(np.arange(len(table) + 1, dtype=np.int32) * np.int32(width))
    return pa.BinaryArray.from_buffers(pa.binary(), len(table), [None, offsets.buffers()[1], pa.py_buffer(table.tobytes())])


def _phrases(source: DataFrame, firsts: DataFrame) -> DataFrame:
    """Phrases of the passages that the first occurrences make up; n: most occurrences of a window that holds one."""
    starts = firsts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("firsts"))
    joined = source.join(starts, F.col("doc_id") == F.col("doc")).select("doc_id", "text", F.transform("firsts", lambda x: x["start"]).alias("starts"), F.transform("firsts", lambda x: x["n"]).alias("counts"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches, most=SLICE_BYTES):
            w = tv.words(*tv.utf8(part.column("text")))
            lists = part.column("starts")
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + w.first[row]
            count = part.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            valid = at + WINDOW <= w.first[row + 1]
            at, row, count = at[valid], row[valid], count[valid]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(at))[: len(head)] - 1
            begin, end = at[head], at[tail] + WINDOW
            size = (end - begin - PHRASE) // STEP + 1
            own = np.repeat(np.arange(len(head)), size)
            q = begin[own] + STEP * tv.spread(size)
            left, right = np.minimum(REACH, q - begin[own]), np.minimum(REACH, end[own] - q - PHRASE)
            most = np.zeros(len(q), np.int64)
            for back in range(REACH + 1):  # windows that begin so many words before the phrase
                place = head[own] + q - begin[own] - back
                held = (back <= left) & (place <= tail[own])
                most[held] = np.maximum(most[held], count[place[held]])
            owner = row[head][own]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            code = tv.ngrams(w.hash, PHRASE)[q] if len(q) else np.zeros(0, np.uint64)
            columns = _places(w, q, left, right, ids[owner].astype(np.int64), q - w.first[owner])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(code.view(np.int64)), pa.array(most)], names=[*PLACE, "code", "n"])

    return joined.mapInArrow(scan, TILE)


def _occurrences(source: DataFrame, anchors, phrases, hot, shards: int) -> DataFrame:
    """Places of stretches that may recur at which a phrase may begin, each for one shard;
    of hot phrases, the document chooses the salt."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches, most=SLICE_BYTES):
            w = tv.words(*tv.utf8(part.column("text")))
            starts, place, grams = window_anchors(w)
            starts = starts[anchors.value.has(grams[place])]
            depth = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(depth, starts, 1)
            np.add.at(depth, starts + WINDOW, -1)
            at = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
            row = w.rows()[at]
            gap = np.ones(len(at), bool)
            gap[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
            head = np.flatnonzero(gap)
            run = np.cumsum(gap) - 1
            begin, end = at[head], at[np.append(head[1:], len(at))[: len(head)] - 1] + 1
            keep = np.flatnonzero(at + PHRASE <= end[run]) if len(at) else at
            q, run = at[keep], run[keep]
            code = tv.ngrams(w.hash, PHRASE)[q] if len(q) else np.zeros(0, np.uint64)
            some = phrases.value.has(code)
            q, run, code = q[some], run[some], code[some]
            left, right = np.minimum(REACH, q - begin[run]), np.minimum(REACH, end[run] - q - PHRASE)
            owner = w.rows()[q]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            for k in range(0, len(q), 20_000):
                cut = slice(k, k + 20_000)
                doc = ids[owner[cut]].astype(np.int64)
                salt = np.where(hot.value.has(code[cut]), (tv.mix(doc.view(np.uint64) + np.uint64(7)) % np.uint64(SALTS)).astype(np.int64), 0)
                yield _deal(_places(w, q[cut], left[cut], right[cut], doc, q[cut] - w.first[owner[cut]]), _shard(code[cut], salt, shards), 1)

    return source.mapInArrow(scan, DEALT)


def _tiles(phrases: DataFrame, hot, shards: int) -> DataFrame:
    """The phrases for their shards; hot ones for all salts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64)
            copies = np.where(hot.value.has(code), SALTS, 1)
            pick = np.repeat(np.arange(len(code)), copies)
            yield _deal(batch.select(PLACE).take(pa.array(pick)).columns, _shard(code[pick], tv.spread(copies), shards), 0)

    return phrases.mapInArrow(scan, DEALT)


class Shard:
    """An automaton over the phrases of a shard; equal phrases share an entry."""

    def __init__(self, phrases: pa.Table):
        around = _table(phrases["around"])
        letters = _letters(around)
        order = np.argsort(letters, kind="stable")
        keys, first = np.unique(letters[order], return_index=True)
        self.first = np.append(first, len(letters))
        self.around = around[order]
        self.doc, self.at, self.left, self.right = (phrases[name].to_numpy()[order] for name in ("doc", "at", "left", "right"))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, key in enumerate(keys.tolist()):
            self.machine.add_word(key.decode("latin-1"), k)
        if len(keys):
            self.machine.make_automaton()

    def locate(self, places: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, first and last word (exclusive) of the repeats that the places of this shard lie in."""
        around = _table(places["around"])
        width = PHRASE * LETTERS + 1
        letters = np.full((len(around), width), GAP_LETTER, np.uint8)
        letters[:, :-1] = _letters(around).view(np.uint8).reshape(len(around), width - 1)
        hits = list(self.machine.iter(letters.tobytes().decode("latin-1"))) if len(self.first) > 1 and len(around) else []
        end, key = np.array(hits, np.int64).reshape(-1, 2).T
        size = self.first[key + 1] - self.first[key]
        tile = np.repeat(self.first[key], size) + tv.spread(size)
        here = np.repeat(end // width, size)
        doc, at, left, right = (places[name].to_numpy() for name in ("doc", "at", "left", "right"))
        found = [self._compare(around, here[k : k + 20_000], tile[k : k + 20_000], doc, at, left, right) for k in range(0, len(here), 20_000)]
        return tuple(np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64) for j in range(3))

    def _compare(self, around: np.ndarray, here: np.ndarray, tile: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        same = around[here] == self.around[tile]
        run = lambda m: np.where(m.all(1), m.shape[1], m.argmin(1))
        before = np.minimum(run(same[:, REACH - 1 :: -1]), np.minimum(self.left[tile], left[here]))
        after = np.minimum(run(same[:, REACH + PHRASE :]), np.minimum(self.right[tile], right[here]))
        own = (doc[here] == self.doc[tile]) & (at[here] == self.at[tile])
        good = same[:, REACH : REACH + PHRASE].all(1) & (before + after >= REACH) & ~own
        here = here[good]
        return doc[here], at[here] - before[good], at[here] + PHRASE + after[good]


def _table(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDTH)


def _letters(around: np.ndarray) -> np.ndarray:
    own = spell(around[:, REACH : REACH + PHRASE].ravel()).reshape(len(around), -1)
    return np.ascontiguousarray(own).view(f"S{PHRASE * LETTERS}").ravel()


def _located(dealt: DataFrame, shards: int) -> DataFrame:
    """doc and its repeats as an array of (begin, end) in words. A task reads a few shards, one after another."""

    rows = dealt.repartition(max(1, -(-shards // 2)), "shard").sortWithinPartitions("shard", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, machine = None, [], None
        for batch in batches:
            shard, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind"))
            cuts = np.concatenate(([0], np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(shard)])).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    now, held, machine = shard[a], [], None
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    machine = machine or Shard(pa.Table.from_batches(held))
                    doc, begin, end = machine.locate(pa.Table.from_batches([batch.slice(a, b - a)]))
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, begin, end)], names=["doc", "begin", "end"])

    found = rows.mapInArrow(scan, "doc long, begin long, end long")
    return found.distinct().groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("repeats"))


def remove_repeats(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (``kept``),
    or without ``with_text`` only their SHA-256 (``kept_sha256``)."""
    share = documents.sparkSession.sparkContext.broadcast
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = source.where("doc_id is not null")
    hot = materialize(_anchors(keyed).groupBy("h").count().where("count > 1").select("h"), "repeat-anchors")
    anchors = share(bitmaps.build(hot, hot.count()))
    firsts = materialize(_recurring(keyed, anchors), "repeat-firsts")
    phrases = materialize(_phrases(keyed, firsts), "repeat-phrases")
    n = phrases.count()
    common = phrases.where(F.col("n") >= HOT).select(F.col("code").alias("h")).distinct()
    known, frequent = share(bitmaps.build(phrases.select(F.col("code").alias("h")), n)), share(bitmaps.build(common, common.count()))
    shards = max(1, -(-n // SHARD))
    dealt = _tiles(phrases, frequent, shards).union(_occurrences(keyed, anchors, known, frequent, shards))
    marks = materialize(_located(dealt, shards), "repeat-marks")
    for shared in (anchors, known, frequent):
        shared.destroy()
    discard(hot, firsts, phrases)
    joined = source.join(marks, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", F.transform("repeats", lambda x: x["begin"]).alias("begin"), F.transform("repeats", lambda x: x["end"]).alias("end"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches, most=SLICE_BYTES):
            buf, offsets = tv.utf8(part.column("text"))
            w = tv.words(buf, offsets)
            depth = np.zeros(len(w.hash) + 1, np.int64)
            lists = part.column("begin").fill_null([])
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            for name, step in (("begin", 1), ("end", -1)):
                place = part.column(name).fill_null([]).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(depth, np.minimum(place + w.first[row], w.first[row + 1]), step)
            gone = np.cumsum(depth[:-1]) > 0
            removed = tv.sums(gone, w.first)
            kept = []
            for r, lost in enumerate(removed.tolist()):
                found = buf[offsets[r] : offsets[r + 1]].tobytes().split()
                if lost:
                    mask = gone[w.first[r] : w.first[r + 1]].tolist()
                    found = [word for word, out in zip(found, mask, strict=True) if not out]
                kept.append(b" ".join(found))
            last = pa.array([b.decode() for b in kept]) if with_text else pa.array([hashlib.sha256(b).hexdigest() for b in kept])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.first)), pa.array(removed), last], names=names)

    names = ["doc_id", "n_words", "n_removed", "kept" if with_text else "kept_sha256"]
    return joined.mapInArrow(finish, f"doc_id long, n_words long, n_removed long, {names[-1]} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False)
