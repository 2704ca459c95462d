"""k-mer counts and k-mer based similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..session import dealt, discard, materialize


def kmer_rows(df: DataFrame, id_: str, seq: str, k: int, canonical: bool = False, skip_ambiguous: bool = False) -> DataFrame:
    """id and kmer, one row per window."""
    rows = df.select(F.col(id_).alias("id"), F.explode(sq.kmers(sq.upper_ascii(F.col(seq)), k, skip_ambiguous)).alias("kmer"))
    return rows.select("id", sq.canonical_kmer(F.col("kmer")).alias("kmer")) if canonical else rows


SLICE_CHARS = 2 << 20


def _windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for the k characters from each place on, equal for equal windows only."""
    used = np.zeros(int(codes.max()) + 1, np.int64)
    used[codes] = 1
    letters, dense = np.flatnonzero(used), (np.cumsum(used) - 1)[codes]
    base, key, top = max(len(letters), 2), dense[: len(dense) - k + 1].astype(np.int64), max(len(letters), 2)
    for j in range(1, k):
        if top > (1 << 62) // base:
            seen, key = np.unique(key, return_inverse=True)
            top = len(seen)
        key = key * base + dense[j : j + len(key)]
        top *= base
    return key


_TURN = str.maketrans("ACGT", "TGCA")


def _strands(key: np.ndarray, at: np.ndarray, text: str, k: int) -> tuple[np.ndarray, list[str]]:
    """The number of each window's lesser strand, and the strands by number; each distinct window of the slice is turned once."""
    _, where, back = np.unique(key, return_index=True, return_inverse=True)
    known: dict[str, int] = {}
    own = [known.setdefault(min(w, w[::-1].translate(_TURN)), len(known)) for w in (text[s : s + k] for s in at[where].tolist())]
    return np.array(own, np.int64)[back], list(known)


def _count_slice(ids: pa.Array, texts: list[str], k: int, canonical: bool = False) -> pa.RecordBatch:
    """Distinct windows of each text with their numbers, and all windows of the text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    places = np.arange(len(codes)) - first[own] if len(codes) else np.zeros(0, np.int64)
    at = np.flatnonzero(places <= (sizes[own] - k)) if len(codes) >= k else np.zeros(0, np.int64)
    key = _windows(codes, k)[at] if len(at) else np.zeros(0, np.int64)
    text = "".join(texts)
    key, strands = _strands(key, at, text, k) if canonical and len(key) else (key, [])
    top = int(key.max()) + 1 if len(key) else 1
    # one number for text and window where it fits sorts six times as fast as the pair
    order = np.argsort(own[at] * top + key) if top < (1 << 62) // max(len(texts), 1) else np.lexsort((key, own[at]))
    at, key = at[order], key[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[at[1:]] != own[at[:-1]])
    head = np.flatnonzero(fresh)
    words = pa.array(strands, pa.string()).take(pa.array(key[head])) if canonical else pa.array([text[s : s + k] for s in at[head].tolist()], pa.string())
    owner = own[at[head]]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(owner)), words, pa.array(np.diff(np.append(head, len(at)))), pa.array(np.maximum(sizes - (k - 1), 0)[owner])],
        names=["id", "kmer", "n", "total"],
    )


def counted_rows(df: DataFrame, id_: str, seq: str, k: int, canonical: bool = False) -> DataFrame:
    """id, kmer, n and total: the distinct windows (or lesser strands of windows) of each row, counted inside the row, and all its windows.

    Rows are counted apart, so nothing is shuffled and no row per window exists.
    """
    source = df.select(F.col(id_).alias("id"), F.coalesce(sq.upper_ascii(F.col(seq)), F.lit("")).alias("s"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, at = batch.column("s").to_pylist(), batch.column("id"), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                    size += len(texts[end])
                    end += 1
                yield _count_slice(ids.slice(at, end - at), texts[at:end], k, canonical)
                at = end

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, kmer string, n long, total long")


def kmer_counts(df: DataFrame, id_: str, seq: str, k: int, canonical: bool = False, relative: bool = False) -> DataFrame:
    """id, kmer and n; with ``relative`` also its share within the id. Ids are expected once; rows that repeat one are counted apart."""
    counted = counted_rows(df, id_, seq, k, canonical)
    return counted.select("id", "kmer", "n", *([(F.col("n") / F.col("total")).alias("share")] if relative else []))


def without_repetitive(df: DataFrame, id_: str, seq: str, k: int, most: int) -> DataFrame:
    """Rows in which no k-mer occurs more than ``most`` times."""
    bad = kmer_counts(df, id_, seq, k).where(F.col("n") > most).select(F.col("id").alias(id_)).distinct()
    return df.join(bad, id_, "left_anti")


#: k-mers of common sets that one block of sequences holds, and pairs that are counted at once.
BLOCK, AT_ONCE = 4 << 20, 2 << 20


def _pairs_between(one: tuple, two: tuple | None, least: float, least_shared: int) -> Iterator[tuple]:
    """(row of one, row of two, shared) of sequences of two blocks (or of one with itself, each pair once) that share enough.

    A block is (sizes, codes, offsets): codes of row r lie between its offsets. The second block is inverted;
    the rows of the first meet it a bounded number of pairs at a time.
    """
    sizes, codes, offsets = one
    far_sizes, far_codes, far_offsets = two or one
    letters, back = np.unique(np.concatenate([codes, far_codes]), return_inverse=True)
    near, far = back[: len(codes)], back[len(codes) :]
    owner = np.repeat(np.arange(len(far_sizes), dtype=np.int32), np.diff(far_offsets))[np.argsort(far, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(far, minlength=len(letters)))])
    del back, far
    times = np.diff(starts)[near]
    upto = np.concatenate([[0], np.cumsum(times)])[offsets]
    row, n = 0, len(sizes)
    while row < n:
        end = max(int(np.searchsorted(upto, upto[row] + AT_ONCE, "right")) - 1, row + 1)
        span = slice(offsets[row], offsets[end])
        many = times[span]
        before = np.cumsum(many) - many
        met = owner[np.repeat(starts[near[span]] - before, many) + np.arange(int(many.sum()))]
        own = np.repeat(np.repeat(np.arange(row, end), np.diff(offsets[row : end + 1])), many)
        if two is None:
            own, met = own[met > own], met[met > own]
        key = np.sort(own * len(far_sizes) + met)
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        shared = np.diff(np.append(head, len(key)))
        a, b = np.divmod(key[head], len(far_sizes))
        fit = (shared >= least_shared) & (shared / np.minimum(sizes[a], far_sizes[b]) >= least)
        if fit.any():
            yield a[fit], b[fit], shared[fit]
        row = end


def _overlaps(key: tuple, batches: Iterator[pa.RecordBatch], least: float, least_shared: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks; key: their numbers, equal for pairs within a block."""
    parts: dict[int, list] = {}
    for batch in batches:
        side = batch.column("side").to_numpy(zero_copy_only=False)
        for k in np.unique(side).tolist():
            parts.setdefault(k, []).append(batch.filter(pa.array(side == k)))

    def block(k: int) -> tuple:
        table = pa.Table.from_batches(parts.pop(k)).combine_chunks()
        lists = table.column("codes").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return table.column("id").combine_chunks(), (table.column("n").to_numpy(), lists.flatten().to_numpy(), offsets - offsets[0])

    if len(parts) < (1 if key[0] == key[1] else 2):
        return
    ids, one = block(0)
    far_ids, two = (ids, None) if key[0] == key[1] else block(1)
    for a, b, shared in _pairs_between(one, two, least, least_shared):
        x, y = ids.take(pa.array(a)), far_ids.take(pa.array(b))
        sizes = one[0][a], (two or one)[0][b]
        yield pa.RecordBatch.from_arrays([x, y, pa.array(shared.astype(np.int64)), pa.array(np.minimum(*sizes).astype(np.int64))], names=["x", "y", "shared", "n"])


def kmer_overlap(df: DataFrame, id_: str, seq: str, k: int, least: float = 0.5, canonical: bool = True, least_shared: int = 1, skip_ambiguous: bool = True) -> DataFrame:
    """Pairs seq_a < seq_b with their shared distinct k-mers over the smaller set (four digits).

    Only k-mers of two sequences or more count. Sequences are dealt to blocks of about BLOCK k-mers, and
    each pair of blocks is one task, which counts through an inverted index: pairs that share too
    little never leave it, memory depends on a block, and each set is sent once for each block.
    """
    # texts of one id meet before they are cut, so no aggregate holds a row for each window
    texts = df.select(F.col(id_).alias("id"), sq.upper_ascii(F.col(seq)).alias("s")).where("id is not null").groupBy("id").agg(F.collect_list("s").alias("s"))
    words = F.flatten(F.transform("s", lambda s: sq.kmers(s, k, skip_ambiguous)))
    sets = materialize(texts.select("id", F.explode(F.array_distinct(F.transform(words, sq.canonical_kmer) if canonical else words)).alias("kmer")), "kmer-sets")
    common = sets.groupBy("kmer").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("kmer")
    coded = materialize(common.withColumn("code", F.monotonically_increasing_id()), "kmer-codes")
    index = sets.join(dealt(coded), "kmer", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("code").alias("codes")).where(F.size("codes") > 0)
    lists = materialize(index, "kmer-lists")
    discard(sets, coded)
    total = lists.agg(F.sum(F.size("codes").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    own = lists.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = own.select(F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), (F.col("_b") > F.col("_o")).cast("int").alias("side"), "id", "n", "codes")
    kind = lists.schema["id"].dataType.simpleString()

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _overlaps(tuple(x.as_py() for x in key), batches, least, least_shared)

    tasks = blocks * (blocks + 1) // 2
    found = sent.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(pairs, f"x {kind}, y {kind}, shared long, n long")
    return found.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"), "shared", F.round(F.col("shared") / F.col("n"), 4).alias("overlap"))


def overlap_edges(pairs: DataFrame) -> DataFrame:
    """k-mer pairs as an edge table."""
    return pairs.select(F.col("seq_a").alias("query_id"), F.col("seq_b").alias("target_id"), F.round(F.col("overlap") * 100, 2).alias("identity"), F.lit(100.0).alias("query_coverage"), F.lit(100.0).alias("target_coverage"), F.lit(1).cast("long").alias("num_alignments"))
