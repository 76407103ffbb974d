"""Saved models and batch scoring."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import vector_array
from ..operators.boosting import BoostedModel
from ..operators.kernel import KernelModel, OneClassModel
from ..operators.lookup import BROADCAST_BYTES, lookup_join, measured_bytes
from ..operators.neighbors import NearestNeighborsModel
from ..operators.outlier_models import IsolationForestModel, MahalanobisModel
from ..operators.perceptron import PerceptronModel
from .heuristics import ProblemType
from .prepare import Recipe
from .training import Trained



@dataclass
class LabelledRows:
    """What is kept of a model that labels the rows it is fitted on: features that were not among them get no label."""

    labels: DataFrame

    @staticmethod
    def of(scored: DataFrame) -> "LabelledRows":
        one = scored.groupBy(vector_array(scored, "features").alias("__vec"))
        return LabelledRows(one.agg(F.min("prediction").cast("double").alias("prediction"), F.count(F.lit(1)).alias("__n")))

    def transform(self, df: DataFrame) -> DataFrame:
        return lookup_join(df.withColumn("__vec", vector_array(df, "features")), self.labels, "__vec").drop("__vec")

    def save(self, path: str) -> None:
        self.labels.write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LabelledRows":
        return LabelledRows(spark.read.parquet(path))


_OWN = {m.__name__: m for m in (NearestNeighborsModel, IsolationForestModel, MahalanobisModel, BoostedModel, KernelModel, OneClassModel, PerceptronModel)}


@dataclass
class Scorer:
    """The best model with its preparation and class names: raw rows in, predictions out."""

    problem_type: ProblemType
    name: str
    recipe: Recipe
    model: Any
    classes: DataFrame | None = None
    fitted_on: DataFrame | None = None

    @staticmethod
    def of(trained: Trained) -> "Scorer":
        return Scorer(trained.problem_type, trained.best.name, trained.recipe, trained.best.model, trained.classes, trained.train)

    def score(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """O1: the ``keep`` columns with ``prediction`` and, for classes, ``predicted`` as their name.

        The same function serves a batch and a stream: it has no state and adds no shuffle.
        """
        hidden = {c: f"__keep{i}" for i, c in enumerate(keep)}
        held = df.select("*", *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
        ready = self.recipe.apply(held, keep=tuple(hidden.values()))
        scored = self.model.transform(ready)
        out = scored.select(
            *[F.col(h).alias(c) for c, h in hidden.items()], F.col("prediction").cast("double").alias("prediction")
        )
        if self.classes is None:
            return out
        names = self.classes.select(F.col("code").cast("double").alias("prediction"), F.col("value").alias("predicted"))
        few = measured_bytes(names) <= BROADCAST_BYTES
        return out.join(F.broadcast(names) if few else names, "prediction", "left").select(*keep, "prediction", "predicted")

    def save(self, spark: SparkSession, path: str) -> None:
        """Into a folder that must not exist yet."""
        kind = type(self.model).__name__
        if kind not in _OWN and not hasattr(self.model, "write"):
            kind = LabelledRows.__name__
        state = {"problem_type": self.problem_type.value, "name": self.name, "model": kind, "classes": self.classes is not None}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/scorer")
        self.recipe.save(spark, path)
        if self.classes is not None:
            self.classes.write.parquet(f"{path}/classes")
        if kind == LabelledRows.__name__:
            LabelledRows.of(self.model.transform(self.fitted_on)).save(f"{path}/model")
        elif kind in _OWN:
            if kind == "NearestNeighborsModel":
                self.model.save(f"{path}/model")
            else:
                self.model.save(f"{path}/model", spark)
        else:
            self.model.write().save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scorer":
        state = json.loads(spark.read.text(f"{path}/scorer").first().value)
        if state["model"] == LabelledRows.__name__:
            model = LabelledRows.load(spark, f"{path}/model")
        elif state["model"] in _OWN:
            model = _OWN[state["model"]].load(spark, f"{path}/model")
        else:
            model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark.sparkContext)
        classes = spark.read.parquet(f"{path}/classes") if state["classes"] else None
        return Scorer(
            ProblemType(state["problem_type"]), state["name"], Recipe.load(spark, path), model, classes
        )
