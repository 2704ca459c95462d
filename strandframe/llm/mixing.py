"""Mixing with soft memberships: document rates that meet domain token targets.

A softmax regression over hashed words, learned from the labelled table, gives
each document posteriors over the domains (the languages of the labelled
rows). With n tokens and posteriors p, document d adds r*n*p[k] expected
tokens to domain k. Rates r >= ``min_rate`` minimise the squared distance of
all domains' expected tokens from their targets by projected gradient steps,
scaled by the inverse of the K x K Gram matrix of the rows that can move and
halved until the distance falls. A step needs two distributed aggregates, one
of K*K sums and one of K sums for each halving; the rate of a document is a fold of its own row over
the K-vectors of all steps, so no rate is ever stored or collected.

Documents without words (null and empty texts among them) have uniform
posteriors and the rate 1: they add no tokens. Repeated rows get equal rates
and equal copies; an empty table gives no rows. Copies are the whole part of
the rate plus one more with the probability of the rest, decided by a hash of
doc_id, so the expected mixture is that of the rates. Other columns are
carried along when asked for, never read. Without labelled rows there is one
domain, ``all``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table
from . import labelled
from . import textvec as tv

TRAIN_ROWS, EPOCHS, BUCKETS = 4000, 6, 1 << 14
STEPS, HALVINGS, TOLERANCE = 40, 8, 1e-9
MIN_RATE = 0.0
#: Least rate in the pipeline, where a document that earlier stages kept stays in the mixture.
STAGE_RATE = 1.0


def _counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a slice, and the first word of each text."""
    w = tv.words(buf, offsets, tv.ALNUM, tv.FOLD)
    return (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), w.first


class DomainModel:
    """Mean of per-word weights, then softmax; posteriors are smoothed by ``soft``."""

    def __init__(self, soft: float = 0.02):
        self.domains, self.weights, self.soft = ["all"], np.zeros((BUCKETS, 1), np.float32), soft

    def fit(self, texts: list[bytes], domains: list[str], seed: int = 9) -> DomainModel:
        if not texts:
            return self
        self.domains = sorted(set(domains))
        k = len(self.domains)
        y = np.array([self.domains.index(d) for d in domains])
        self.weights = np.zeros((BUCKETS, k), np.float32)
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in texts]))).astype(np.int64)
        ids, first = _counts(np.frombuffer(b"".join(texts), np.uint8), offsets)
        memory = np.full(self.weights.shape, 1e-6, np.float32)
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for take in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64)):
                size = first[take + 1] - first[take]
                at = np.repeat(first[take], size) + tv.spread(size)
                row = np.repeat(np.arange(len(take)), size)
                error = self._posterior(ids[at], np.concatenate(([0], np.cumsum(size))))
                error[np.arange(len(take)), y[take]] -= 1
                own, back = np.unique(ids[at], return_inverse=True)
                share = (error / np.maximum(size, 1)[:, None])[row]
                g = np.stack([np.bincount(back, share[:, j], len(own)) for j in range(k)], 1).astype(np.float32)
                memory[own] += g * g
                self.weights[own] -= 0.5 * g / np.sqrt(memory[own])
        return self

    def _posterior(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        k = self.weights.shape[1]
        size = np.diff(first)
        acc = np.zeros((len(ids) + 1, k))
        np.cumsum(self.weights[ids], axis=0, out=acc[1:])
        z = (acc[first[1:]] - acc[first[:-1]]) / np.maximum(size, 1)[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and posteriors of each text."""
        ids, first = _counts(buf, offsets)
        p = self._posterior(ids, first)
        k = len(self.domains)
        p = (1 - self.soft) * p + self.soft / k
        p[np.diff(first) == 0] = 1 / k
        return np.diff(first), p


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DomainModel:
    """From at most ``rows`` labelled documents (a documented bound) and their languages."""

    def fit(got: list[tuple]) -> DomainModel:
        got = [r for r in got if r[3] is not None]
        return DomainModel().fit([(r[1] or "").encode() for r in got], [str(r[3]) for r in got])

    return labelled.fitted(labelled.sample_rows(documents, labels, "quality", 1, -1, rows, ("lang",)), fit)


def memberships(documents: DataFrame, model: DomainModel, keep: list[str]) -> DataFrame:
    """Columns of ``keep``, ``n_tokens`` and ``posterior``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = documents.select(*dict.fromkeys([*keep, "text"]))
    shape = source.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.array(F.lit(0.0)).alias("posterior")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches):
            n, p = shared.value.score(*tv.utf8(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.shape[1], pa.int32()), pa.array(np.round(p, 6).ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n.astype(np.int64)), lists], names=[*keep, "n_tokens", "posterior"])

    return source.mapInArrow(scan, shape)


def _rate(steps: list[list[float]], scale: float, floor: float) -> Column:
    """The rate after these steps: each moves along the row's own tokens, then is cut at the floor."""
    one = F.lit(max(1.0, floor)).cast("double")
    if not steps:
        return one
    path = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    mass = F.col("n_tokens") * F.lit(1.0 / scale)
    dot = lambda s: F.aggregate(F.zip_with("posterior", s, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    fold = F.aggregate(path, one, lambda r, s: F.greatest(F.lit(float(floor)), r + mass * dot(s)))
    return F.when(F.col("n_tokens") > 0, fold).otherwise(F.lit(1.0))


def fit_rates(members: DataFrame, targets: list[float], floor: float = MIN_RATE, steps: int = STEPS) -> tuple[Column, dict]:
    """The rate as an expression over ``members``, and what the fit reached.

    ``targets`` are shares of tokens. The total is the least for which no
    domain must lose tokens where rates have a floor of 1, else the present one.
    """
    k = len(targets)
    mass = [F.col("n_tokens") * F.col("posterior")[j] for j in range(k)]
    row = members.agg(*[F.sum(m).alias(f"s{j}") for j, m in enumerate(mass)], *[F.sum(m * m).alias(f"q{j}") for j, m in enumerate(mass)]).first()
    have = np.array([row[f"s{j}"] or 0.0 for j in range(k)])
    if not have.sum():
        return F.lit(1.0), {"targets": [0.0] * k, "expected": [0.0] * k, "steps": 0}
    scale = float(np.sqrt(sum(row[f"q{j}"] for j in range(k))))
    share = np.array(targets) / sum(targets)
    total = have.sum() if floor < 1 else float(max(h / s for h, s in zip(have, share, strict=True) if s > 0))
    goal, path, now, done = share * total, [], have * max(1.0, floor), 0

    def gram(gap: np.ndarray) -> np.ndarray:
        """Of the rows that may move: those off the floor, or at it and drawn upward."""
        pull = sum((m * float(g) for m, g in zip(mass, gap / scale, strict=True)), F.lit(0.0))
        free = members.withColumn("_r", _rate(path, scale, floor)).where((F.col("_r") > floor + 1e-9) | (pull > 0))
        row = free.agg(*[F.sum(mass[i] * mass[j] / F.lit(scale**2)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        return np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    def trials(step: np.ndarray) -> np.ndarray:
        """Expected tokens after the step and after each of its halvings, in one aggregate."""
        pull = sum((m * float(x) for m, x in zip(mass, step / scale, strict=True)), F.lit(0.0))
        moved = members.select("n_tokens", "posterior", _rate(path, scale, floor).alias("_r"), pull.alias("_d")).where("n_tokens > 0")
        rate = lambda h: F.greatest(F.lit(float(floor)), F.col("_r") + F.col("_d") * 0.5**h)
        got = moved.agg(*[F.sum(rate(h) * m).alias(f"s{h}_{j}") for h in range(HALVINGS) for j, m in enumerate(mass)]).first()
        return np.array([[got[f"s{h}_{j}"] or 0.0 for j in range(k)] for h in range(HALVINGS)])

    while done < steps and np.abs(goal - now).max() > TOLERANCE * total:
        done += 1
        step, before = np.linalg.pinv(gram(goal - now), rcond=1e-10) @ ((goal - now) / scale), now
        for h, trial in enumerate(trials(step)):  # the first that brings the distance down
            if np.linalg.norm(goal - trial) < np.linalg.norm(goal - now):
                path.append((step * 0.5**h).tolist())
                now = trial
                break
        if np.abs(now - before).max() <= TOLERANCE * total:
            break
    return _rate(path, scale, floor), {"targets": goal.tolist(), "expected": now.tolist(), "steps": done}


def gap(report: dict) -> float:
    """The largest miss of a target as a share of all tokens."""
    total = sum(report["targets"])
    return max(abs(t - e) for t, e in zip(report["targets"], report["expected"], strict=True)) / total if total else 0.0


def mix(documents: DataFrame, labels: DataFrame, keep: list[str], weights: dict[str, float] | None = None, floor: float = MIN_RATE) -> tuple[DataFrame, dict]:
    """Columns of ``keep``, n_tokens, posterior, rate and copies; and the report of the fit.

    ``weights`` gives the target share of each domain; domains not named get
    none, and without weights all domains get the same.
    """
    model = train(documents, labels)
    members = materialize(memberships(documents, model, keep), "members")
    targets = [1.0 if weights is None else float(weights.get(d, 0.0)) for d in model.domains]
    rate, report = fit_rates(members, targets, floor)
    whole = members.withColumn("rate", F.round(rate, 6))
    luck = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return whole.withColumn("copies", F.coalesce(copies, F.lit(1))), report | {"domains": model.domains}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed, report = mix(docs, read_table(spark, sf_dir, "labels"), ["doc_id", "source"])
    return mixed.withColumn("target_gap", F.lit(round(gap(report), 9)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its rate (STAGE_RATE at least) and copies, equal shares for all languages, and how far a target is missed.

    Columns of ``docs`` that have a name of the result go on as ``<name>_before``.
    """
    ours = ("n_tokens", "posterior", "rate", "copies", "target_gap")
    names: dict[str, str] = {}
    for c in docs.columns:
        new = f"{c}_before" if c in ours else c
        while new != c and (new in docs.columns or new in names.values()):
            new += "_before"
        names[c] = new
    docs = docs.withColumnsRenamed(names)
    mixed, report = mix(docs, read_table(spark, sf_dir, "labels"), docs.columns, floor=STAGE_RATE)
    return mixed.withColumn("target_gap", F.lit(round(gap(report), 9)))
