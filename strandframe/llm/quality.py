"""Quality scores from a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 8 bytes slide by 4 over the whole text;
each chunk of 1,024 bytes (neighbours overlap by half) keeps the largest
answer of every filter; a layer turns a chunk into hidden units, whose maximum
and mean over all chunks give one probability. Training follows the gradient
through the maxima, so a step costs little more than the pass forward.

The network learns from at most ``TRAIN_ROWS`` labelled rows (a documented
bound, chosen by a hash of doc_id); all other work is per document. A null or
empty text is one chunk of padding and gets a score too; repeated rows get
equal scores; an empty table gives no rows; without labelled rows of both
classes every score is the share of label 1 (0.5 without any). Only
``doc_id`` and ``text`` are read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import labelled
from . import textvec as tv

TRAIN_ROWS, STEPS, BATCH, RATE = 6000, 900, 32, 0.01
FOLDS, HELD = 4, 2
STRIDE, BLOCK, DIM, FILTERS, HIDDEN = 4, 512, 8, 32, 12
GROUP = 512  # blocks convolved at a time


def padded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in whole blocks, each with 8 bytes or more of padding; first block of each."""
    sizes = np.diff(offsets)
    blocks = (sizes + 8 + BLOCK - 1) // BLOCK
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(first[-1] * BLOCK + STRIDE, np.uint8)
    for r, size in enumerate(sizes.tolist()):
        at = first[r] * BLOCK
        out[at : at + size] = buf[offsets[r] : offsets[r + 1]]
    return out, first


class ByteNet:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "E": normal(256, DIM, scale=0.5),
            "W": normal(2 * STRIDE * DIM, FILTERS, scale=0.2),
            "b": np.zeros(FILTERS, np.float32),
            "V": normal(FILTERS, HIDDEN, scale=0.25),
            "c": np.zeros(HIDDEN, np.float32),
            "u": normal(2 * HIDDEN, scale=0.2),
            "d": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def pooled(self, data: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest answer of every filter in each block (and its position)."""
        p, n = self.p, int(first[-1])
        half = STRIDE * DIM
        last = np.zeros(n, bool)
        last[first[1:] - 1] = True
        out = np.empty((n, FILTERS), np.float32)
        where = np.empty((n, FILTERS), np.int64) if places else None
        steps = BLOCK // STRIDE
        for at in range(0, n, GROUP):
            end = min(at + GROUP, n)
            x = p["E"][data[at * BLOCK : end * BLOCK + STRIDE]].reshape(-1, half)
            y = x[:-1] @ p["W"][:half]
            y += x[1:] @ p["W"][half:]
            y = y.reshape(end - at, steps, FILTERS)
            y[last[at:end], -1] = -np.inf  # this window reaches into the next text
            if places:
                k = y.argmax(1)
                where[at:end] = k + (np.arange(at, end) * steps)[:, None]
                out[at:end] = np.take_along_axis(y, k[:, None], 1)[:, 0]
            else:
                y.max(axis=1, out=out[at:end])
        return out + p["b"], where

    def forward(self, data: np.ndarray, first: np.ndarray, places: bool = False) -> dict:
        p = self.p
        top, where = self.pooled(data, first, places)
        act = np.maximum(top, 0)
        n = len(act)
        nxt = np.arange(1, n + 1)
        nxt[first[1:] - 1] -= 1  # the last block of a text is joined with none
        chunk = np.maximum(act, act[nxt])
        h = np.maximum(chunk @ p["V"] + p["c"], 0)
        sizes = np.diff(first)
        high = np.maximum.reduceat(h, first[:-1])
        mean = np.add.reduceat(h, first[:-1]) / sizes[:, None]
        z = np.concatenate((high, mean), 1)
        return {"top": top, "where": where, "act": act, "nxt": nxt, "chunk": chunk, "h": h, "high": high, "z": z, "logit": z @ p["u"] + p["d"][0]}

    def gradients(self, data: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, f = self.p, self.forward(data, first, places=True)
        sizes = np.diff(first)
        row = np.repeat(np.arange(len(sizes)), sizes)
        dlogit = ((labelled.sigmoid(f["logit"]) - y) * weight / len(y)).astype(np.float32)
        g = {"u": f["z"].T @ dlogit, "d": dlogit.sum(keepdims=True)}
        dz = dlogit[:, None] * p["u"]
        hit = f["h"] == f["high"][row]
        ties = np.add.reduceat(hit.astype(np.float32), first[:-1])
        dh = (hit * (dz[:, :HIDDEN] / ties)[row] + (dz[:, HIDDEN:] / sizes[:, None])[row]) * (f["h"] > 0)
        g["V"], g["c"] = f["chunk"].T @ dh, dh.sum(0)
        dchunk = dh @ p["V"].T
        own = f["act"] >= f["act"][f["nxt"]]
        dact = dchunk * own
        np.add.at(dact, f["nxt"], dchunk * ~own)
        dtop = dact * (f["top"] > 0)
        g["b"] = dtop.sum(0)
        k, c = np.nonzero(dtop)
        d = dtop[k, c]
        window = data[(f["where"][k, c] * STRIDE)[:, None] + np.arange(2 * STRIDE)]
        seen = p["E"][window].reshape(len(k), -1)
        g["W"] = np.zeros_like(p["W"])
        dW = g["W"].T
        back = (d[:, None] * p["W"].T[c]).reshape(-1, DIM)
        flat = window.ravel()
        g["E"] = np.stack([np.bincount(flat, back[:, j], 256) for j in range(DIM)], 1).astype(np.float32)
        for j in range(FILTERS):
            m = c == j
            dW[j] = d[m] @ seen[m]
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> ByteNet:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng, adam = np.random.default_rng(seed), labelled.Adam(self.p, RATE)
        order: list[int] = []
        for step in range(steps):
            if len(order) < BATCH:
                order = rng.permutation(len(texts)).tolist()
            take, order = order[:BATCH], order[BATCH:]
            blob = [texts[k] for k in take]
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in blob]))).astype(np.int64)
            data, first = padded(np.frombuffer(b"".join(blob), np.uint8), offsets)
            adam.step(self.gradients(data, first, y[take], np.ones(len(take), np.float32)), min(1.0, 3 * (1 - step / steps)))
        return self

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        data, first = padded(buf, offsets)
        return labelled.sigmoid(self.forward(data, first)["logit"].astype(np.float64))



def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ByteNet:
    some = labelled.sample_rows(documents, labels, "quality", FOLDS, HELD, rows)
    return labelled.fitted(some, lambda got: ByteNet().fit([(r[1] or "").encode() for r in got], np.array([r[2] for r in got], np.float32)))


def with_score(documents: DataFrame, net: ByteNet, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``doc_id`` (or the columns of ``keep``) and the score in column ``name``."""
    model = documents.sparkSession.sparkContext.broadcast(net)
    if keep is None:
        source, keep = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id"]
    else:
        source = documents.select(*keep)
    shape = source.select(*keep, F.lit(0.0).alias(name)).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tv.slices(batches):
            score = np.round(model.value.score(*tv.utf8(part.column("text"))), 6)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score)], names=[*keep, name])

    return source.mapInArrow(scan, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return labelled.scored(with_score(docs, train(docs, read_table(spark, sf_dir, "labels"))), FOLDS, HELD)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut."""
    net, name = train(docs, read_table(spark, sf_dir, "labels")), "_score"
    while name in docs.columns:
        name = f"_{name}"
    return with_score(docs, net, keep=docs.columns, name=name).where(F.col(name) >= labelled.CUT).drop(name)
