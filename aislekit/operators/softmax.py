"""Multinomial logistic regression on coded rows by trust-region Newton steps.

Minimises ``c * sum(weight_i * loss_i) + |W|^2 / 2``, intercepts without penalty, as the reference does.  A step solves the
Newton equations by conjugate gradients (Steihaug), preconditioned by the Hessian's diagonal; gradient and each Hessian-vector
product are one aggregate over the kept rows: a task sums over its documents in numpy and hands on one row, rows of tasks are
added up in groups before the rest reaches the driver.  Rows are kept in blocks of documents, each column as the bytes of an
array, so that a pass reads them without taking lists apart.  Parameters are classes x (terms + 1) numbers, whatever the number of documents.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small
from . import termrows as R
from .features import balanced_weights

#: Relative size of the gradient at which the solver stops.
TOLERANCE = 1e-6
MAX_STEPS = 100
#: Entries of a block of documents, unless one document has more.
BLOCK = 1 << 18
_BLOCKS = "size binary, idx binary, w binary, y binary, weight binary"
_PART = "part long, sums binary"


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``idx, w, y, weight`` rows as blocks of about ``BLOCK`` entries."""
    for batch in batches:
        size = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int32)
        ends = size.cumsum(dtype=np.int64)
        at = 0
        while at < len(batch):
            before = int(ends[at - 1]) if at else 0
            n = max(1, int(np.searchsorted(ends, before + BLOCK, "right")) - at)
            part = batch.slice(at, n)
            columns = [size[at:at + n], part.column(0).flatten().to_numpy(), part.column(1).flatten().to_numpy(),
                       part.column(2).to_numpy(), part.column(3).to_numpy()]
            kinds = (np.int32, np.int32, np.float64, np.int32, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([c.astype(k).tobytes()], pa.binary()) for c, k in zip(columns, kinds, strict=True)],
                                             names=["size", "idx", "w", "y", "weight"])
            at += n


class Sums:
    """Aggregates over ``idx, w, y, weight`` rows, kept where all passes read them."""

    def __init__(self, data: DataFrame, classes: int, terms: int) -> None:
        self.data = cut_lineage(data.select("idx", "w", "y", "weight").mapInArrow(_blocks, _BLOCKS))
        self.shape = (classes, terms + 1)
        self.passes = 0

    def _collect(self, per_batch, sent, size: int) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for block in zip(*(batch.column(i) for i in range(5)), strict=True):
                    lengths, idx, w, y, weight = (np.frombuffer(c.as_buffer(), k) for c, k in zip(
                        block, (np.int32, np.int32, np.float64, np.int32, np.float64), strict=True))
                    per_batch(total, sent.value, lengths, idx.astype(np.int64), w, y, weight)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        def added(group: pd.DataFrame) -> pd.DataFrame:
            total = sum((np.frombuffer(b) for b in group.sort_values("part")["sums"]), np.zeros(size))
            return pd.DataFrame({"part": [int(group["part"].min())], "sums": [total.tobytes()]})

        self.passes += 1
        parts = self.data.mapInArrow(summed, _PART)
        tasks = self.data.rdd.getNumPartitions()
        if tasks > 64:
            parts = parts.groupBy((F.col("part") % math.isqrt(tasks)).alias("g")).applyInPandas(added, _PART)
        rows = sorted(parts.collect(), key=lambda r: r["part"])  # as many numbers as the model has, from 64 tasks or the root of all
        sent.unpersist()
        return sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(size))

    def gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and the Hessian's diagonal of the weighted loss."""
        classes, width = self.shape

        def batch(total, theta, lengths, idx, w, y, weight):
            n = len(lengths)
            p = _softmax(_products(lengths, idx, w, theta))
            total[0] -= float(weight @ np.log(np.maximum(p[np.arange(n), y], 1e-300)))
            g, h = total[1:1 + classes * width].reshape(classes, width), total[1 + classes * width:].reshape(classes, width)
            _add(h, weight[:, None] * p * (1 - p), lengths, idx, w * w)
            p[np.arange(n), y] -= 1
            _add(g, weight[:, None] * p, lengths, idx, w)

        size = classes * width
        out = self._collect(batch, self.data.sparkSession.sparkContext.broadcast(theta), 1 + 2 * size)
        return float(out[0]), out[1:1 + size].reshape(self.shape), out[1 + size:].reshape(self.shape)

    def curvature(self, theta: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The Hessian of the weighted loss times ``v``."""
        def batch(total, both, lengths, idx, w, y, weight):
            theta, v = both
            p = _softmax(_products(lengths, idx, w, theta))
            z = _products(lengths, idx, w, v)
            z = p * (z - (p * z).sum(axis=1, keepdims=True))
            _add(total.reshape(theta.shape), weight[:, None] * z, lengths, idx, w)

        out = self._collect(batch, self.data.sparkSession.sparkContext.broadcast((theta, v)), self.shape[0] * self.shape[1])
        return out.reshape(self.shape)


def _products(lengths: np.ndarray, idx: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The rows (with a 1 at the end) times each class's parameters; a row has ``lengths`` entries."""
    out = np.zeros((len(lengths), len(theta)))
    full = np.flatnonzero(lengths)
    first = (lengths.cumsum(dtype=np.int64) - lengths)[full]
    for c in range(len(theta) if len(full) else 0):
        out[full, c] = np.add.reduceat(theta[c].take(idx) * w, first)
    return out + theta[:, -1]


def _add(total: np.ndarray, r: np.ndarray, lengths: np.ndarray, idx: np.ndarray, w: np.ndarray) -> None:
    """Adds the outer products of ``r`` and the rows (with a 1 at the end)."""
    for c in range(total.shape[0]):
        total[c, :-1] += np.bincount(idx, np.repeat(r[:, c], lengths) * w, total.shape[1] - 1)
        total[c, -1] += r[:, c].sum()


def _steihaug(product, gradient: np.ndarray, scale: np.ndarray, radius: float, tolerance: float, most: int) -> tuple[np.ndarray, float]:
    """A step and the fall it promises, inside a region of the scaled norm, by preconditioned conjugate gradients."""
    s, r = np.zeros_like(gradient), -gradient
    hs = np.zeros_like(gradient)
    z = r / scale
    d, rz = z.copy(), float((r * z).sum())
    first = rz
    norm = lambda x: math.sqrt(float((scale * x * x).sum()))
    for _ in range(most):
        if rz <= tolerance * tolerance * first:
            break
        hd = product(d)
        bend = float((d * hd).sum())
        step = rz / bend if bend > 0 else math.inf
        if bend <= 0 or norm(s + step * d) >= radius:  # to the edge of the region
            a, b, c = norm(d) ** 2, float((scale * s * d).sum()), norm(s) ** 2 - radius ** 2
            step = (-b + math.sqrt(max(0.0, b * b - a * c))) / a
            s, hs = s + step * d, hs + step * hd
            break
        s, hs, r = s + step * d, hs + step * hd, r - step * hd
        z = r / scale
        rz, before = float((r * z).sum()), rz
        d = z + rz / before * d
    return s, -float((gradient * s).sum()) - 0.5 * float((s * hs).sum())


def solve(sums: Sums, c: float = 1.0, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, float]:
    """Parameters (classes x (terms + 1)) and the objective they reach."""
    ridge = np.ones(sums.shape)
    ridge[:, -1] = 0

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, g, h = sums.gradient(theta)
        return c * loss + 0.5 * float((ridge * theta * theta).sum()), c * g + ridge * theta, np.maximum(c * h + ridge, 1e-9)

    theta = np.zeros(sums.shape)
    value, g, scale = at(theta)
    begin = float(np.sqrt((g * g / scale).sum()))
    radius = max(begin, 1.0)
    for _ in range(max_steps):
        size = float(np.sqrt((g * g / scale).sum()))
        if size <= tolerance * max(begin, 1e-300):
            break
        product = lambda v: c * sums.curvature(theta, v) + ridge * v  # noqa: B023, E731
        step, promised = _steihaug(product, g, scale, radius, min(0.1, math.sqrt(size / begin)), theta.size)
        new = at(theta + step)
        gained = (value - new[0]) / promised if promised > 0 else 0.0
        long = float(np.sqrt((scale * step * step).sum()))
        radius = 0.25 * long if gained < 0.25 else max(radius, 2 * long) if gained > 0.75 else radius
        if promised <= 1e-12 * max(1.0, abs(value)):
            break
        if gained > 1e-4:
            theta, (value, g, scale) = theta + step, new
    theta[:, -1] -= theta[:, -1].mean()  # a common shift of the intercepts changes nothing
    return theta, value


@dataclass
class SoftmaxModel:
    """``theta`` is classes x (terms + 1), the last column holds the intercepts; classes by code."""

    theta: np.ndarray
    label_codes: DataFrame
    objective: float = float("nan")
    passes: int = 0
    kind: str = "logistic_regression"

    def _scored(self, rows: DataFrame) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(self.theta)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            theta = sent.value
            for batch in batches:
                n = len(batch)
                row = np.repeat(np.arange(n), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
                idx, w = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                p = _softmax(R.products(row, idx, w, n, theta[:, :-1].T) + theta[:, -1]) if n else np.zeros((0, len(theta)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(p.argmax(axis=1).astype(np.int32) if n else [], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(theta)), pa.array(p.ravel()))],
                    names=["doc_id", "code", "p"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.select("doc_id", "idx", "w").mapInArrow(scored, f"doc_id {kind}, code int, p array<double>")

    def predict_labels(self, rows: DataFrame) -> DataFrame:
        """``doc_id, predicted, predicted_code`` of coded rows; ties go to the smallest code."""
        return self._scored(rows).select("doc_id", "code").join(self.label_codes, "code").select(
            "doc_id", F.col("label").alias("predicted"), F.col("code").cast("int").alias("predicted_code"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``doc_id, label, code, proba`` per class."""
        parts = self._scored(rows).select("doc_id", F.posexplode("p").alias("code", "proba"))
        return parts.join(self.label_codes, "code").select("doc_id", "label", F.col("code").cast("int").alias("code"), "proba")


def fit(labelled: DataFrame, vocab_size: int, label_codes: DataFrame, c: float = 1.0, tolerance: float = TOLERANCE,
        max_steps: int = MAX_STEPS) -> SoftmaxModel:
    """M12 on ``doc_id, idx, w, label`` rows with balanced weights."""
    codes = label_codes.select("label", F.col("code").cast("int").alias("y"))
    weights = balanced_weights(labelled, "label").select("label", "weight")
    # one row a class: documents stay where they are, and are not dealt by class
    of_class = cut_lineage(weights.join(codes, "label"))
    data = labelled.select("idx", "w", "label").join(small(of_class), "label")
    classes = (codes.agg(F.max("y")).first()[0] or 0) + 1
    sums = Sums(data, classes, vocab_size)
    theta, value = solve(sums, c, tolerance, max_steps)
    return SoftmaxModel(theta, label_codes, value, sums.passes)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library
