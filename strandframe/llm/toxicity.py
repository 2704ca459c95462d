"""Toxicity scores from a convolutional text classifier over hashed words, in numpy.

A word (ASCII case ignored) is the sum of two hashed embeddings, of the whole
word and of its first bytes, so inflected forms share a part. Filters of one,
two and three words slide over the whole text; the largest answer of each goes
into one logistic unit. A language is guessed from the words of the text alone,
by log-odds of hashed words learned from the training rows (their ``lang`` is a
target of that guess, never an input), and the cut on the raw probability is
calibrated for each language on a part of the training rows that the fit does
not see: the score is scaled so that a language's cut becomes 0.7.

All labelled rows outside the held-out fold train, whatever their length. One
task starts the filters on a few shards of them (about ``TRAIN_ROWS`` rows);
then every shard goes through all its rows, ``PASSES`` times, each from the
weights that are the mean of all shards of the pass before (weighted by rows).
Words of languages and the counts behind the cuts are summed over all rows,
too; raw probabilities are counted on a grid of ``GRID`` cells, whose edges are
the possible cuts. A null, empty or wordless text has the score of no words; repeated rows get equal scores; an
empty table gives no rows; without rows of both classes every score is the
share of label 1 (0.5 without any). Only ``doc_id`` and ``text`` are read for
a score.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, read_table
from . import labelled
from . import textvec as tv

TRAIN_ROWS, STEPS, BATCH, RATE = 8000, 1500, 32, 0.02
FOLDS, HELD = 3, 1
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
PREFIX = 4
#: One training row in this many calibrates the cuts; a language needs so many of each class.
CALIBRATE, LEAST = 5, 8
GAP = max(WIDTHS) - 1
#: Shards of the start; rates of the passes over all shards; pieces in which weights are summed; cells of raw probabilities.
START, PASSES, PIECES, GRID = 2, (0.5, 0.1), 32, 1 << 12
#: Bytes of text at which a step ends before it has BATCH rows.
STEP_BYTES = 1 << 20


class Tokens:
    """Word and prefix buckets of a slice, GAP empty places after each text; first place of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        w = tv.words(buf, offsets, tv.ALNUM, tv.FOLD)
        n = len(w.hash)
        stem = np.zeros(n, np.uint64)
        for k in range(PREFIX):
            at = w.start + k
            inside = at < w.end
            stem |= np.where(inside, tv.FOLD[buf[np.minimum(at, max(len(buf) - 1, 0))]], 0).astype(np.uint64) << np.uint64(8 * k) if n else stem
        size = len(offsets) - 1
        place = np.arange(n) + GAP * w.rows()
        self.first = w.first + GAP * np.arange(size + 1)
        self.word = np.full(self.first[-1], BUCKETS, np.int64)
        self.stem = np.full(self.first[-1], BUCKETS, np.int64)
        mask = np.uint64(BUCKETS - 1)
        self.word[place] = (w.hash & mask).astype(np.int64)
        self.stem[place] = (tv.mix(stem) & mask).astype(np.int64)


class WordNet:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.tables = [normal(BUCKETS + 1, DIM, scale=0.1) for _ in range(2)]
        for t in self.tables:
            t[BUCKETS] = 0
        self.p = {f"W{w}": normal(w * DIM, FILTERS, scale=0.3) for w in WIDTHS} | {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.p |= {"u": normal(FILTERS * len(WIDTHS), scale=0.3), "d": np.full(1, -1.0, np.float32)}
        self.languages: list[str] = []
        self.speak = np.zeros((BUCKETS + 1, 0), np.float32)
        self.cuts = np.full(1, 0.5)
        self.constant: float | None = None

    def pooled(self, t: Tokens, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        x = self.tables[0][t.word] + self.tables[1][t.stem]
        tops, wheres = [], []
        n = len(x)
        sizes = np.diff(t.first)
        for w in WIDTHS:
            y = x[: n - w + 1] @ self.p[f"W{w}"][:DIM]
            for k in range(1, w):
                y += x[k : n - w + 1 + k] @ self.p[f"W{w}"][k * DIM : (k + 1) * DIM]
            # so many places as there are words and gaps, those beyond the last window out of reach
            y = np.concatenate((y, np.full((n - len(y), FILTERS), -np.inf, np.float32)))
            # places that reach into the next text lie in the gap; the first of the gap may stay
            top = np.maximum.reduceat(y, t.first[:-1]) if w == 1 else self._inner(y, t.first, w)
            tops.append(top + self.p[f"b{w}"])
            if places:
                hit = np.repeat(top, sizes, 0) == y
                at = np.where(hit, np.arange(len(y))[:, None], n)
                wheres.append(np.minimum.reduceat(at, t.first[:-1]))
        return np.concatenate(tops, 1), np.concatenate(wheres, 1) if places else None, x

    @staticmethod
    def _inner(y: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
        for k in range(1, w):  # windows that begin in the last w - 1 places of a text's range
            at = first[1:] - k
            y[at] = -np.inf
        return np.maximum.reduceat(y, first[:-1])

    def raw(self, t: Tokens) -> np.ndarray:
        top, _, _ = self.pooled(t)
        return labelled.sigmoid((np.maximum(top, 0) @ self.p["u"] + self.p["d"][0]).astype(np.float64))

    def learn_languages(self, texts: list[str], langs: list[str | None]) -> None:
        """Log-odds of each word bucket for every language that has LEAST texts or more."""
        many = Counter(x for x in langs if x is not None)
        names = sorted(x for x, n in many.items() if n >= LEAST)
        counts = np.zeros((BUCKETS + 1, len(names)), np.int64)
        for k, name in enumerate(names):
            counts[:, k] = np.bincount(tokens([t for t, x in zip(texts, langs, strict=True) if x == name]).word, minlength=BUCKETS + 1)
        self.set_languages(names, counts)

    def set_languages(self, names: list[str], words: np.ndarray) -> None:
        """From the number of words of each bucket and language."""
        self.languages, counts = names, words + 0.1
        odds = np.log(counts / counts.sum(0)) if names else counts
        self.speak = (odds - odds.mean(1, keepdims=True) if names else odds).astype(np.float32)
        self.speak[BUCKETS] = 0
        self.cuts = np.full(len(names) + 1, 0.5)

    def guess(self, t: Tokens) -> np.ndarray:
        """The likeliest language of each text; -1 without a word."""
        if not self.languages:
            return np.full(len(t.first) - 1, -1)
        votes = np.add.reduceat(self.speak[t.word], t.first[:-1])
        return np.where((votes != 0).any(1), votes.argmax(1), -1)

    def _step(self, t: Tokens, y: np.ndarray, adam: labelled.Adam, seen: list[np.ndarray], scale: float) -> None:
        top, where, x = self.pooled(t, places=True)
        act = np.maximum(top, 0)
        d = ((labelled.sigmoid(act @ self.p["u"] + self.p["d"][0]) - y) / len(y)).astype(np.float32)
        g = {"u": act.T @ d, "d": d.sum(keepdims=True)}
        dtop = d[:, None] * self.p["u"] * (top > 0)
        rows, grads = [], []
        for j, w in enumerate(WIDTHS):
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            dj, at = dtop[:, cols], where[:, cols]
            g[f"b{w}"] = dj.sum(0)
            window = np.minimum(at[..., None] + np.arange(w), len(x) - 1)
            g[f"W{w}"] = np.einsum("df,dfk->kf", dj, x[window].reshape(*at.shape, -1))
            rows.append(window.ravel())
            grads.append((dj[..., None] * self.p[f"W{w}"].T).reshape(-1, DIM))
        adam.step(g, scale)
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        for table, memory, ids in zip(self.tables, seen, (t.word, t.stem), strict=True):
            own, back = np.unique(ids[rows], return_inverse=True)
            total = np.stack([np.bincount(back, grads[:, k], len(own)) for k in range(DIM)], 1).astype(np.float32)
            total[own == BUCKETS] = 0
            memory[own] += total * total
            table[own] -= 0.1 * scale * total / (np.sqrt(memory[own]) + 1e-6)

    def fit(self, texts: list[str], y: np.ndarray, langs: list[str | None] | None = None, steps: int = STEPS, seed: int = 3) -> WordNet:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.learn_languages(texts, langs or [None] * len(texts))
        apart = np.arange(len(texts)) % CALIBRATE == CALIBRATE - 1
        if min((y[~apart] == 1).sum(), (y[~apart] == 0).sum()) == 0:
            apart[:] = False
        learn = np.flatnonzero(~apart)
        self.start([texts[k] for k in learn], y[learn], steps, seed)
        if apart.any():
            self.calibrate(self.outcomes(tokens([texts[k] for k in np.flatnonzero(apart)]), y[apart]))
        return self

    def start(self, texts: list[str], y: np.ndarray, steps: int = STEPS, seed: int = 3) -> tuple[labelled.Adam, list[np.ndarray]]:
        """Steps over random batches; returns what the optimisers remember."""
        rng, adam = np.random.default_rng(seed), labelled.Adam(self.p, RATE)
        seen = [np.full(t.shape, 1e-8, np.float32) for t in self.tables]
        order: list[int] = []
        for step in range(steps if texts else 0):
            if len(order) < BATCH:
                order = rng.permutation(len(texts)).tolist()
            take, order = order[:BATCH], order[BATCH:]
            self._step(tokens([texts[k] for k in take]), y[take], adam, seen, min(1.0, 2 * (1 - step / steps)))
        return adam, seen

    def flat(self) -> np.ndarray:
        """All weights that steps change, as one array."""
        return np.concatenate([x.ravel() for x in (*self.tables, *self.p.values())])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.tables, *self.p.values()):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def outcomes(self, t: Tokens, y: np.ndarray) -> np.ndarray:
        """Texts by guessed language (the last: none), cell of the raw probability, and label."""
        counts = np.zeros((len(self.languages) + 1, GRID, 2), np.int64)
        cell = np.minimum((self.raw(t) * GRID).astype(np.int64), GRID - 1)
        np.add.at(counts, (self.guess(t), cell, (y == 1).astype(np.int64)), 1)
        return counts

    def calibrate(self, counts: np.ndarray) -> None:
        """The cut with fewest errors; in the middle where several have as few."""

        def best(c: np.ndarray) -> float:  # errors of a cut at the lower edge of each cell, and above all
            errors = np.concatenate(([0], np.cumsum(c[:, 1]))) + c[:, 0].sum() - np.concatenate(([0], np.cumsum(c[:, 0])))
            good = np.flatnonzero(errors == errors.min())
            return float(np.clip(good[len(good) // 2] / GRID, 0.05, 0.95))

        self.cuts = np.full(len(self.languages) + 1, best(counts.sum(0)) if counts.sum((0, 1)).all() else 0.5)
        for k in range(len(self.languages)):
            if counts[k].sum(0).min() >= LEAST:
                self.cuts[k] = best(counts[k])

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None or len(offsets) < 2:
            return np.full(len(offsets) - 1, self.constant or 0.0)
        t = Tokens(buf, offsets)
        raw, cut = self.raw(t), self.cuts[self.guess(t)]
        return np.where(raw >= cut, labelled.CUT + (1 - labelled.CUT) * (raw - cut) / (1 - cut), labelled.CUT * raw / cut)


def tokens(texts: list[str]) -> Tokens:
    blob = [t.encode() for t in texts]
    return Tokens(np.frombuffer(b"".join(blob), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in blob]))).astype(np.int64))


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, Tokens, np.ndarray]]:
    for part in tv.slices(batches, most=most):
        yield part, Tokens(*tv.utf8(part.column("text"))), part.column("label").to_numpy(zero_copy_only=False).astype(np.float32)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts where a shard ends and after BATCH rows."""
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
        for at, end in zip(edges, edges[1:], strict=False):
            for k in range(at, end, BATCH):
                yield batch.slice(k, min(BATCH, end - k))


def _sums(table: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of the counts that ``make`` returns of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = make(batches).ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    got = table.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(shape)


def _word_counts(table: DataFrame, names: list[str]) -> np.ndarray:
    shape = (BUCKETS + 1, len(names))

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros((len(names), BUCKETS + 1), np.int64)
        for part, t, _ in _slices(batches, 1 << 20):
            lang = np.repeat(np.array([names.index(x) if x in names else -1 for x in part.column("lang").to_pylist()], np.int64), np.diff(t.first))
            for k in range(len(names)):
                counts[k] += np.bincount(t.word[lang == k], minlength=BUCKETS + 1)
        return counts.T

    return _sums(table, make, shape) if names else np.zeros(shape, np.int64)


def _pass(table: DataFrame, net: WordNet, memory: tuple[labelled.Adam, list[np.ndarray]], scale: float) -> None:
    """One pass of all shards over their rows, from the same weights; then the mean of where they arrived."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps((net, *memory)))
    begin = net.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, total, rows, here = None, None, np.zeros(len(begin)), 0, 0

        def close() -> None:
            nonlocal total, rows, here
            total += here * (own[0].flat().astype(np.float64) - begin)
            rows, here = rows + here, 0

        at = None
        for part, t, y in _slices(_steps(batches), STEP_BYTES):
            shard = part.column("shard")[0].as_py()
            if shard != at:
                if own is not None:
                    close()
                else:
                    first = shard
                at, own = shard, pickle.loads(shared.value)
                own[1].params = own[0].p
            own[0]._step(t, y, own[1], own[2], scale)
            here += part.num_rows
        if own is None:
            return
        close()
        for k, piece in enumerate(np.array_split(total, PIECES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([first], pa.int32()), pa.array([rows], pa.int64()), pa.array([piece.tobytes()], pa.binary())], names=["piece", "first", "n", "moved"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("first", "ascending"), ("n", "ascending"), ("moved", "ascending")])
        moved = sum(np.frombuffer(x, np.float64) for x in group.column("moved").to_pylist()) / sum(group.column("n").to_pylist())
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "moved": pa.array([moved.tobytes()], pa.binary())})

    parts = table.mapInArrow(run, "piece int, first int, n long, moved binary").groupBy("piece").applyInArrow(add, "piece int, moved binary").collect()
    net.put((begin + np.concatenate([np.frombuffer(r.moved, np.float64) for r in sorted(parts, key=lambda r: r.piece)])).astype(np.float32))
    shared.destroy()


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> WordNet:
    """From all labelled rows; ``rows`` is about how many start the filters."""
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    whole, shards = labelled.every_row(documents.withColumn("lang", lang), labels, "toxic", FOLDS, HELD, max(1, rows // START), ("lang",))
    table = materialize(whole.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(CALIBRATE)), F.lit(CALIBRATE)) == CALIBRATE - 1), "toxic")
    try:
        return _train(table, shards)
    finally:
        discard(table)


def _train(table: DataFrame, shards: int) -> WordNet:
    many = {(r.apart, r.label): r["count"] for r in table.groupBy("apart", F.col("label").alias("label")).count().collect()}
    total = sum(many.values())
    if len({label for _, label in many}) < 2:
        net = WordNet()
        net.constant = sum(label * n for (_, label), n in many.items()) / total if total else 0.5
        return net
    apart = all(sum(n for (a, x), n in many.items() if not a and (x == 1) == one) for one in (True, False))
    learn = table.where("not apart") if apart else table
    some = learn.where((F.col("shard") < START) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= labelled.MOST_BYTES))

    def start(got: list[tuple]) -> tuple[WordNet, tuple[labelled.Adam, list[np.ndarray]], int]:
        net = WordNet()
        return net, net.start([r[1] or "" for r in got], np.array([r[2] for r in got], np.float32)), len(got)

    net, memory, begun = labelled.fitted(some.select("doc_id", "text", "label"), start)
    if begun < sum(n for (a, _), n in many.items() if not (a and apart)):
        for scale in PASSES:
            _pass(learn, net, memory, scale)
    names = sorted(r.lang for r in table.where("lang is not null").groupBy("lang").count().where(F.col("count") >= LEAST).collect())
    net.set_languages(names, _word_counts(table, names))
    if apart and any(a for a, _ in many):
        shared = table.sparkSession.sparkContext.broadcast(net)

        def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            model = shared.value
            counts = np.zeros((len(model.languages) + 1, GRID, 2), np.int64)
            for _, t, y in _slices(batches, 1 << 20):
                counts += model.outcomes(t, y)
            return counts

        net.calibrate(_sums(table.where("apart"), make, (len(names) + 1, GRID, 2)))
    return net


def with_score(documents: DataFrame, net: WordNet) -> DataFrame:
    model = documents.sparkSession.sparkContext.broadcast(net)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches, most=1 << 20):
            score = np.round(model.value.score(*tv.utf8(part.column("text"))), 6)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(scan, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return labelled.scored(with_score(docs, train(docs, read_table(spark, sf_dir, "labels"))), FOLDS, HELD)
