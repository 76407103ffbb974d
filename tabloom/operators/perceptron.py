"""Perceptrons with hidden layers and a penalty on the weights (M6), fitted by full gradients.

Each step is one pass over the rows: a task sums losses and gradients of its rows in matrix blocks, sums meet in
about the square root of as many tasks, and the driver sees that many vectors of one number per weight. The path of
the weights is that of limited-memory BFGS.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import matrix, vector_array

_BATCH = 2_000
# The steps end when ten of them lower the loss by less than this share.
TOLERANCE = 1e-4
_PATIENCE = 10
_MEMORY = 10


@dataclass
class Net:
    """Rectified hidden layers and a softmax; all weights in one vector, a matrix and its shifts per layer."""

    layers: tuple[int, ...]
    flat: np.ndarray

    @staticmethod
    def draw(layers: tuple[int, ...], seed: int) -> "Net":
        """Uniform weights scaled by the width of a layer's two sides; no shifts."""
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(layers, layers[1:]):
            bound = np.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
        return Net(tuple(layers), np.concatenate(parts))

    def pairs(self, flat: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weights, shifts) of each layer as views of the vector."""
        flat, at, out = self.flat if flat is None else flat, 0, []
        for a, b in zip(self.layers, self.layers[1:]):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def shares(self, x: np.ndarray, kept: list[np.ndarray] | None = None) -> np.ndarray:
        """Probabilities of the classes; ``kept`` collects the input of each layer."""
        pairs = self.pairs()
        for i, (w, b) in enumerate(pairs):
            if kept is not None:
                kept.append(x)
            x = x @ w + b
            if i < len(pairs) - 1:
                x = np.maximum(x, 0.0)
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def sums(self, x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
        """Cross-entropy of the rows and its gradient, both summed, without the penalty."""
        inputs: list[np.ndarray] = []
        share = self.shares(x, inputs)
        rows = np.arange(len(x))
        loss = float(-np.log(np.maximum(share[rows, label], 1e-300)).sum())
        gradient = np.empty_like(self.flat)
        back = share.copy()
        back[rows, label] -= 1.0
        for i in reversed(range(len(inputs))):
            w, _ = self.pairs()[i]
            into, shift = self.pairs(gradient)[i]
            into[:], shift[:] = inputs[i].T @ back, back.sum(axis=0)
            if i:
                back = (back @ w.T) * (inputs[i] > 0)
        return loss, gradient

    def penalty(self, alpha: float) -> tuple[float, np.ndarray]:
        """Half of ``alpha`` times the squared weights; shifts are free."""
        gradient = np.zeros_like(self.flat)
        total = 0.0
        for (w, _), (into, _) in zip(self.pairs(), self.pairs(gradient)):
            into[:] = alpha * w
            total += 0.5 * alpha * float((w * w).sum())
        return total, gradient


def _lean(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNotNull()).select(vector_array(df, "features").alias("x"), F.col("label").cast("int").alias("y"))


def gradient_sums(lean: DataFrame, net: Net, n_tasks: int) -> tuple[float, int, np.ndarray]:
    """(loss, rows, gradient) summed over the (x, y) rows; sums of ``n_tasks`` tasks meet in a tree of two levels."""
    shared = lean.sparkSession.sparkContext.broadcast(net)
    schema = "task int, loss double, n bigint, gradient binary"

    def row(task: int, loss: float, n: int, gradient: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int32()), pa.array([loss]), pa.array([n], pa.int64()), pa.array([gradient.tobytes()])],
            names=["task", "loss", "n", "gradient"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        loss, n, total = 0.0, 0, np.zeros_like(own.flat)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy()
            for at in range(0, len(x), _BATCH):
                value, gradient = own.sums(x[at : at + _BATCH], y[at : at + _BATCH])
                loss, n, total = loss + value, n + len(x[at : at + _BATCH]), total + gradient
        if n:
            yield row(TaskContext.get().partitionId(), loss, n, total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["task"])
        if rows:
            total = sum(np.frombuffer(r["gradient"]) for r in rows)
            yield row(rows[0]["task"], sum(r["loss"] for r in rows), sum(r["n"] for r in rows), total)

    sums = lean.mapInArrow(count, schema)
    if n_tasks > 64:
        sums = sums.repartition(int(np.sqrt(n_tasks)), "task").mapInArrow(meet, schema)
    # Sums are added in one order, so that reruns agree.
    rows = sorted(sums.collect(), key=lambda r: r.task)
    shared.destroy()
    total = sum((np.frombuffer(bytes(r.gradient)) for r in rows), np.zeros_like(net.flat))
    return sum(r.loss for r in rows), sum(r.n for r in rows), total


def descend(
    of: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, list[float]]:
    """Limited-memory BFGS with halved steps: (x, values). Each call of ``of`` gives a value and its gradient."""
    value, gradient = of(x)
    values, moves = [value], []
    for _ in range(steps):
        direction = gradient.copy()
        factors = []
        for s, y in reversed(moves):
            factors.append((s @ direction) / (s @ y))
            direction -= factors[-1] * y
        if moves:
            s, y = moves[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(factors)):
            direction += (a - (y @ direction) / (s @ y)) * s
        slope = gradient @ direction
        if slope <= 0:
            direction, slope, moves = gradient.copy(), gradient @ gradient, []
        step = 1.0 if moves else min(1.0, 1.0 / max(float(np.abs(gradient).sum()), 1e-12))
        while True:
            there = x - step * direction
            new_value, new_gradient = of(there)
            if new_value <= value - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if not new_value < value:
            break
        moved, turned = there - x, new_gradient - gradient
        if moved @ turned > 1e-12:
            moves = [*moves[1 - _MEMORY :], (moved, turned)]
        x, value, gradient = there, new_value, new_gradient
        values.append(value)
        if len(values) > _PATIENCE and values[-1 - _PATIENCE] - value < tolerance * max(abs(value), 1e-12):
            break
    return x, values


@dataclass
class Perceptron:
    """M6: ``hidden`` widths, ``alpha`` the penalty on the squared weights, spread over the rows.

    Labels are 0 .. n_classes - 1; rows without a label are left out. No rows raise ``ValueError``.
    """

    hidden: tuple[int, ...] = (64, 32)
    alpha: float = 1e-4
    n_classes: int = 2
    steps: int = 500
    seed: int = 42

    def fit(self, df: DataFrame) -> "PerceptronModel":
        # Every step reads the rows: their vectors are made into arrays once.
        lean = _lean(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(lean)
        finally:
            lean.unpersist()

    def _fit(self, lean: DataFrame) -> "PerceptronModel":
        first = lean.first()
        if first is None:
            raise ValueError("no rows to fit on")
        n_tasks = lean.rdd.getNumPartitions()
        net = Net.draw((len(first.x), *self.hidden, max(self.n_classes, 2)), self.seed)

        def of(flat: np.ndarray) -> tuple[float, np.ndarray]:
            here = Net(net.layers, flat)
            loss, n, gradient = gradient_sums(lean, here, n_tasks)
            bound, pull = here.penalty(self.alpha)
            return (loss + bound) / n, (gradient + pull) / n

        flat, values = descend(of, net.flat, self.steps)
        return PerceptronModel(Net(net.layers, flat), values)


class PerceptronModel:
    """Adds ``probability`` and ``prediction``, the most probable class and the first of equals."""

    def __init__(self, net: Net, values: list[float]):
        self.net, self.values = net, values

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.net)

        @F.pandas_udf("array<double>")
        def shares(vec: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.shares(matrix(vec))) if len(vec) else [], dtype=object)

        p = F.col("probability")
        scored = df.withColumn("probability", shares(vector_array(df, "features")))
        return scored.withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double"))

    def save(self, path: str, spark: SparkSession) -> None:
        state = {"layers": list(self.net.layers), "flat": self.net.flat.tolist(), "values": self.values}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PerceptronModel":
        s = json.loads(spark.read.parquet(path).first().state)
        return PerceptronModel(Net(tuple(s["layers"]), np.array(s["flat"])), s["values"])
