"""Anomaly models over a feature vector: isolation forest (M14) and Mahalanobis distance."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import as_double, col
from .blocks import matrix
from .isolation import SAMPLE, TREES, IsolationForest, fit_isolation_forest, score_cut


def _width(df: DataFrame, features: str) -> int:
    return int(df.select(features).first()[0].size)


def _spread_out(df: DataFrame, features: str, width: int) -> DataFrame:
    """The vector as double columns v0, v1, … next to the row's own columns."""
    values = vector_to_array(col(features))
    return df.select("*", *[values[i].alias(f"v{i}") for i in range(width)])


def _save_state(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/state")


def _load_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/state").first().value)


class IsolationForestEstimator:
    def __init__(self, contamination: float = 0.05, trees: int = TREES, sample: int = SAMPLE, seed: int = 42):
        self.contamination, self.trees, self.sample, self.seed = contamination, trees, sample, seed

    def fit(self, df: DataFrame) -> "IsolationForestModel":
        width = _width(df, "features")
        plain = _spread_out(df.select("features"), "features", width)
        names = [f"v{i}" for i in range(width)]
        forest = fit_isolation_forest(plain, names, self.trees, self.sample, self.seed)
        cut = score_cut(plain.select(forest.score(plain).alias("score")), "score", self.contamination)
        return IsolationForestModel(forest, cut)


class IsolationForestModel:
    """Adds ``score`` and ``prediction``: -1 above the cut learned in fitting, else 1."""

    def __init__(self, forest: IsolationForest, cut: float):
        self.forest, self.cut = forest, cut

    def transform(self, df: DataFrame) -> DataFrame:
        plain = _spread_out(df, "features", len(self.forest.columns))
        scored = plain.withColumn("score", self.forest.score(plain)).drop(*self.forest.columns)
        return scored.withColumn("prediction", F.when(F.col("score") > F.lit(self.cut), -1).otherwise(1))

    def save(self, path: str, spark: SparkSession) -> None:
        _save_state(spark, path, {"forest": self.forest.to_json(), "cut": self.cut})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForestModel":
        s = _load_state(spark, path)
        return IsolationForestModel(IsolationForest.from_json(s["forest"]), s["cut"])


class MahalanobisEstimator:
    """Distance from the centre in units of the covariance, cut at the (1 - nu) quantile."""

    def __init__(self, nu: float = 0.05):
        self.nu = nu

    def fit(self, df: DataFrame) -> "MahalanobisModel":
        lean = df.select("features")
        moments = lean.select(Summarizer.metrics("mean", "std").summary(col("features")).alias("s")).first().s
        mean, std = np.array(moments["mean"].toArray()), np.array(moments["std"].toArray())
        # A constant feature has no correlation and no covariance.
        correlation = np.nan_to_num(Correlation.corr(lean, "features").first()[0].toArray())
        covariance = correlation * np.outer(std, std)
        values, vectors = np.linalg.eigh(covariance)
        usable = values > 1e-12 * max(values.max(), 1e-300)
        whiten = vectors[:, usable] / np.sqrt(values[usable])
        model = MahalanobisModel(mean, whiten, 0.0)
        cut = score_cut(model.scored(lean), "score", self.nu)
        return MahalanobisModel(mean, whiten, cut)


class MahalanobisModel:
    """Adds ``score`` (the distance) and ``prediction``: -1 above the cut, else 1."""

    def __init__(self, mean: np.ndarray, whiten: np.ndarray, cut: float):
        self.mean, self.whiten, self.cut = mean, whiten, cut

    def scored(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.whiten))

        @F.pandas_udf(T.DoubleType())
        def distance(vec: pd.Series) -> pd.Series:
            mean, whiten = shared.value
            return pd.Series(np.linalg.norm((matrix(vec) - mean) @ whiten, axis=1) if len(vec) else [])

        return df.withColumn("score", distance(vector_to_array(col("features"))))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scored(df).withColumn("prediction", F.when(F.col("score") > F.lit(self.cut), -1).otherwise(1))

    def save(self, path: str, spark: SparkSession) -> None:
        _save_state(
            spark, path, {"mean": self.mean.tolist(), "whiten": self.whiten.tolist(), "cut": self.cut}
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> "MahalanobisModel":
        s = _load_state(spark, path)
        return MahalanobisModel(np.array(s["mean"]), np.array(s["whiten"]), s["cut"])


def z_scores(df: DataFrame, column: str, output: str = "score") -> DataFrame:
    """M15 for one column: |x - mean| in units of the sample deviation."""
    x = as_double(df, column)
    row = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    spread = row.s if row.s else 1.0
    return df.withColumn(output, F.abs(x - F.lit(row.m if row.m is not None else 0.0)) / F.lit(spread))
