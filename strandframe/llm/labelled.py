"""What the trained scorers share: the labelled rows, bounded or all, fits in a task and the score query."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Largest text that trains: a bound of the sample, not of what is scored.
MOST_BYTES = 1 << 16
#: Most ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def labelled_ids(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """doc_id and label of every labelled row outside the held-out fold; of repeated ids the least label."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(fold_of(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )


def sample_rows(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fold: doc_id, text, label, *extra.

    Which ones is decided by a hash of doc_id alone. Null labels and repeated
    doc_ids (the least label and the least text stay) are settled first; the
    ids, bounded by ``limit``, are broadcast to the scan of documents. Texts of
    more than ``MOST_BYTES`` do not train, so the sample is bounded in bytes;
    they are scored whole like all others.
    """
    ids = labelled_ids(labels, label, folds, held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    some = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES).join(F.broadcast(ids), "doc_id")
    return some.groupBy("doc_id").agg(F.min(F.struct("text", "label", *extra)).alias("r")).select("doc_id", "r.*")


def every_row(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, size: int, extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """All labelled rows outside the held-out fold: shard, doc_id, text, label, *extra; and the number of shards.

    Texts of any length are in. A shard has about ``size`` rows, chosen and
    ordered by hashes of doc_id; repeated doc_ids are settled as in
    ``sample_rows``. Few ids are broadcast to the scan of documents.
    """
    ids = labelled_ids(labels, label, folds, held)
    n = ids.count()
    shards = max(1, -(-n // size))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    some = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int"))
    own = some.repartition(shards, "shard").groupBy("shard", "doc_id").agg(F.min(F.struct("text", "label", *extra)).alias("r"))
    return own.select("shard", "doc_id", "r.*").sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id"), shards


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int, extra: tuple[str, ...] = ()) -> list:
    """The rows of ``sample_rows`` as tuples by doc_id."""
    rows = sample_rows(documents, labels, label, folds, held, limit, extra).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1] or ""))


def fitted(rows: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """``fit`` of a bounded table's rows, sorted by the first two columns, run in one task: neither texts nor the fit take the driver's memory."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for batch in batches:
            columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
            got += zip(*([x.decode(errors="replace") if isinstance(x, bytes) else x for x in c.to_pylist()] for c in columns), strict=True)
        got.sort(key=lambda r: (r[0], r[1] or ""))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got))], pa.binary())], names=["model"])

    made = rows.select(*names).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Steps for a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (self.rate * scale * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.params[k].dtype)


CUT = 0.7


def scored(frame: DataFrame, folds: int, held: int) -> DataFrame:
    """The result columns of a score query from doc_id and score."""
    return frame.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
