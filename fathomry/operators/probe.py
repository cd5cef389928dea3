"""Linear probe: softmax regression on frozen features.

One run of gradient descent with momentum over all rows. Each epoch is one job: tasks sum the gradients of their rows as one matrix,
a few tasks add those up, and the driver gets their sums, each of the size of the model. Held-out accuracy is counted at the wanted
epochs of the same run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import _matrix


def _with_bias(column: pa.ChunkedArray) -> np.ndarray:
    x = _matrix(column)
    return np.c_[np.ones(len(x)), x]


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum over rows (x, label) of the cross-entropy's gradient at the weights (class x (1 + dimension)), and their number."""
    slots = max(1, math.isqrt(rows.sparkSession.sparkContext.defaultParallelism))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(weights), 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            x, y = _with_bias(t.column("x")), t.column("label").to_numpy()
            z = x @ weights.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            total += p.T @ x
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int32()), pa.array([total.tobytes()]), pa.array([n])], names=["slot", "g", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g.as_buffer()) for g in t.column("g"))
        return pa.table({"slot": t.column("slot").slice(0, 1), "g": pa.array([total.tobytes()]), "n": pa.array([sum(t.column("n").to_pylist())])})

    kinds = "slot int, g binary, n long"
    found = rows.mapInArrow(each, kinds).groupBy("slot").applyInArrow(add, kinds).collect()  # as many matrices as slots
    return sum((np.frombuffer(r["g"]).reshape(weights.shape) for r in found), np.zeros_like(weights)), sum(r["n"] for r in found)


def accuracy(rows: DataFrame, weights: np.ndarray, ks: tuple[int, ...]) -> list[float | None]:
    """Share of rows (x, label) whose label is among the k largest scores; of equal ones the lesser class is the larger."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            z, y = _with_bias(t.column("x")) @ weights.T if t.num_rows else np.zeros((0, len(weights))), t.column("label").to_numpy()
            known = y < len(weights)
            mine = np.where(known, z[np.arange(len(y)), np.minimum(y, len(weights) - 1)], -np.inf)[:, None]
            ahead = ((z > mine) | ((z == mine) & (np.arange(len(weights)) < y[:, None]))).sum(axis=1)
            ahead[~known] = np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(ahead)], names=["ahead"])

    return list(rows.mapInArrow(each, "ahead long").agg(*[F.avg((F.col("ahead") < k).cast("double")) for k in ks]).first())


def linear_probe(train: DataFrame, test: DataFrame, *, epochs: tuple[int, ...], rate: float = 1.0, momentum: float = 0.9, penalty: float = 0.0) -> DataFrame:
    """epochs, top1, top5 on held-out rows after each of those numbers of passes over the data, in one run; the best and the last are A16's. Both sides: x, label (from 0). Rows without a vector or a label are left out; a class that train lacks is never right."""
    spark = train.sparkSession
    sides = [df.select("x", F.col("label").cast("int").alias("label")).where("x is not null and label is not null").persist(StorageLevel.MEMORY_AND_DISK) for df in (train, test)]
    shape = sides[0].agg((F.max("label") + 1).alias("c"), F.max(F.size("x")).alias("d")).first()
    out = []
    if shape["c"] is not None:
        weights = np.zeros((shape["c"], 1 + shape["d"]))
        speed = np.zeros_like(weights)
        for n in range(1, max(epochs) + 1):
            g, rows = gradient(sides[0], weights)
            speed = momentum * speed - rate * (g / rows + penalty * weights)
            weights = weights + speed
            if n in epochs:
                out.append((n, *accuracy(sides[1], weights, (1, 5))))
    for side in sides:
        side.unpersist()
    return spark.createDataFrame(out, "epochs int, top1 double, top5 double")
