"""Machines with a Gaussian kernel (M5, M15) on random Fourier features (Rahimi and Recht, 2007).

The kernel exp(-gamma |x - y|^2) is the mean of cos(w(x - y)) over normal w, so the products of a few hundred seeded
cosines estimate it without bias, and a linear model on them is a kernel machine whose cost is linear in the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import classification
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import col
from ..session import spread, tasks_for
from .blocks import matrix, vector_array
from .isolation import score_cut

FEATURES = 512
# Steps of the one-class machine; each one is a pass for a quantile and one for a mean.
STEPS = 25
_BATCH = 1_000
# Bytes of mapped features of a task of the linear fit, at most.
_TASK_BYTES = 64 << 20


@dataclass
class FourierFeatures:
    """cos(x W + b) sqrt(2 / D): ``weights`` is features x D."""

    weights: np.ndarray
    shifts: np.ndarray
    # Rows that the features were fitted on, where they were.
    rows: int = 0

    @staticmethod
    def draw(width: int, gamma: float, size: int = FEATURES, seed: int = 42) -> "FourierFeatures":
        rng = np.random.default_rng(seed)
        return FourierFeatures(rng.normal(scale=np.sqrt(2 * gamma), size=(width, size)), rng.uniform(0, 2 * np.pi, size))

    @staticmethod
    def fit(df: DataFrame, gamma: float | None = None, size: int = FEATURES, seed: int = 42) -> "FourierFeatures":
        """``gamma`` is one over the number of features times the variance of all their values, unless it is given."""
        if df.isEmpty():
            raise ValueError("no rows to fit on")
        s = df.select(Summarizer.metrics("mean", "variance", "count").summary(col("features")).alias("s")).first().s
        mean, n = np.array(s["mean"].toArray()), s["count"]
        within = np.array(s["variance"].toArray()) * (n - 1) / n
        spread = float(within.mean() + mean.var())
        drawn = FourierFeatures.draw(len(mean), gamma or 1.0 / (len(mean) * (spread or 1.0)), size, seed)
        return replace(drawn, rows=n)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.cos(x @ self.weights + self.shifts) * np.sqrt(2.0 / len(self.shifts))

    def column(self, df: DataFrame) -> Column:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def mapped(vec: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.of(matrix(vec))) if len(vec) else [], dtype=object)

        return mapped(vector_array(df, "features"))

    def state(self) -> dict:
        return {"weights": self.weights.tolist(), "shifts": self.shifts.tolist()}

    @staticmethod
    def of_state(state: dict) -> "FourierFeatures":
        return FourierFeatures(np.array(state["weights"]), np.array(state["shifts"]))


@dataclass
class KernelClassifier:
    """M5: support vectors with the kernel ``rbf`` or ``linear``, one against the rest beyond two classes."""

    kernel: str = "rbf"
    reg_param: float = 0.01
    n_classes: int = 2
    gamma: float | None = None
    size: int = FEATURES
    seed: int = 42

    def fit(self, df: DataFrame) -> "KernelModel":
        one = classification.LinearSVC(regParam=self.reg_param, maxIter=100, standardization=False)
        estimator = classification.OneVsRest(classifier=one) if self.n_classes > 2 else one
        if self.kernel == "linear":
            return KernelModel(None, estimator.fit(df))
        features = FourierFeatures.fit(df, self.gamma, self.size, self.seed)
        # A mapped row is many times its own size, so one file of rows would be one task with all of them.
        tasks = tasks_for(df.sparkSession, features.rows, max(1, _TASK_BYTES // (8 * self.size)))
        dealt = spread(df.select("features", "label"), tasks)
        lean = dealt.select(array_to_vector(features.column(dealt)).alias("features"), "label")
        return KernelModel(features, estimator.fit(lean))


class KernelModel:
    """Adds ``prediction``; the features stay as they are."""

    def __init__(self, features: FourierFeatures | None, model):
        self.features, self.model = features, model

    def transform(self, df: DataFrame) -> DataFrame:
        if self.features is None:
            return self.model.transform(df)
        held = df.withColumn("__own", col("features")).withColumn("features", array_to_vector(self.features.column(df)))
        return self.model.transform(held).drop("features").withColumnRenamed("__own", "features")

    def save(self, path: str, spark: SparkSession) -> None:
        state = json.dumps(self.features.state() if self.features else None)
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.parquet(f"{path}/features")
        self.model.write().save(f"{path}/linear")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "KernelModel":
        state = json.loads(spark.read.parquet(f"{path}/features").first().state)
        model = DefaultParamsReader.loadParamsInstance(f"{path}/linear", spark.sparkContext)
        return KernelModel(FourierFeatures.of_state(state) if state else None, model)


@dataclass
class OneClassMachine:
    """The smallest mean of at least a share ``nu`` of the rows, seen from the origin of the kernel's space.

    The dual of the one-class machine spreads a weight of one over the rows, at most 1 / (nu n) each, so that the
    squared length of the weighted mean is least. The best answer to a direction is the share ``nu`` of the rows with
    the lowest scores; a step goes towards their mean as far as that shortens the length (Frank and Wolfe), so no step
    size has to be chosen and only a quantile and a mean are computed over the rows. Rows beyond the ``1 - nu``
    quantile of the final score are flagged.
    """

    nu: float = 0.05
    gamma: float | None = None
    size: int = FEATURES
    steps: int = STEPS
    seed: int = 42

    def fit(self, df: DataFrame) -> "OneClassModel":
        features = FourierFeatures.fit(df, self.gamma, self.size, self.seed)
        lean = df.select("features")
        w = _mean(lean, features, None, 0.0)
        for _ in range(self.steps):
            model = OneClassModel(features, w, 0.0)
            cut = -score_cut(model.scored(lean), "score", self.nu)
            tail = _mean(lean, features, w, cut)
            gap = w - tail
            # The least length on the way from w to the tail's mean.
            step = float(np.clip(w @ gap / max(gap @ gap, 1e-300), 0.0, 1.0))
            if step <= 1e-6:
                break
            w = w - step * gap
        model = OneClassModel(features, w, 0.0)
        return OneClassModel(features, w, score_cut(model.scored(lean), "score", self.nu))


def _mean(df: DataFrame, features: FourierFeatures, w: np.ndarray | None, cut: float) -> np.ndarray:
    """The mean of the mapped rows, of those that score at most ``cut`` where there is a direction ``w``."""
    shared = df.sparkSession.sparkContext.broadcast((features, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, direction = shared.value
        total, n = np.zeros(len(own.shifts)), 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at in range(0, len(x), _BATCH):
                z = own.of(x[at : at + _BATCH])
                if direction is not None:
                    z = z[z @ direction <= cut + 1e-12]
                total, n = total + z.sum(axis=0), n + len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n])], names=["total", "n"])

    sums = df.select(vector_array(df, "features").alias("x")).mapInArrow(run, "total array<double>, n bigint")
    # One vector of fixed length; the elements meet by position.
    by_place = sums.select("n", F.posexplode("total").alias("at", "v")).groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v"))
    return np.array([r.v for r in by_place.orderBy("at").collect()])


class OneClassModel:
    """Adds ``score`` (greater is stranger) and ``prediction``: -1 above the cut, else 1."""

    def __init__(self, features: FourierFeatures, w: np.ndarray, cut: float):
        self.features, self.w, self.cut = features, w, cut

    def scored(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.features, self.w))

        @F.pandas_udf("double")
        def score(vec: pd.Series) -> pd.Series:
            own, w = shared.value
            return pd.Series(-(own.of(matrix(vec)) @ w) if len(vec) else [], dtype=float)

        return df.withColumn("score", score(vector_array(df, "features")))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scored(df).withColumn("prediction", F.when(F.col("score") > F.lit(self.cut), -1).otherwise(1))

    def save(self, path: str, spark: SparkSession) -> None:
        state = {**self.features.state(), "w": self.w.tolist(), "cut": self.cut}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "OneClassModel":
        s = json.loads(spark.read.parquet(path).first().state)
        return OneClassModel(FourierFeatures.of_state(s), np.array(s["w"]), s["cut"])
