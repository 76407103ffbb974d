"""What drives a model."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import as_double, col, numeric_columns
from ..operators.forest import forest_of
from ..operators.metrics import classification_metrics, regression_metrics, silhouette, silhouette_verdict
from ..operators.metrics import NOISE
from ..operators.shap import mean_abs_shap
from ..session import written
from .heuristics import ProblemType
from .training import Trained

IMPORTANCE_SCHEMA = "feature string, importance double"
# Rows of the hold-out that trees are explained by.
EXPLAINED_ROWS = 500


def linear_importance(df: DataFrame, coefficients: Mapping[str, float]) -> DataFrame:
    """Mean |coefficient * (x - mean x)| of each column: the mean absolute SHAP value of a linear model."""
    x = {c: as_double(df, c) for c in coefficients}
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x.values())]).first()
    structs = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.abs(F.lit(float(coefficients[c])) * (x[c] - F.lit(means[i])))).alias("importance"),
        )
        for i, c in enumerate(x)
    ]
    return df.agg(F.array(*structs).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def _deviations(df: DataFrame, features: str = "features") -> list[float]:
    """Mean absolute deviation of each vector entry: a pass for the means and one for the sums around them."""
    centred = StandardScaler(inputCol=features, outputCol="__centred", withMean=True, withStd=False).fit(df).transform(df)
    row = centred.select(Summarizer.metrics("normL1", "count").summary(F.col("__centred")).alias("s")).first().s
    return [float(x) / row["count"] for x in row.normL1]


def _model_weights(model) -> tuple[str, np.ndarray] | None:
    """("linear", one weight per feature), where the model has them."""
    if hasattr(model, "coefficientMatrix"):
        return "linear", np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return "linear", np.abs(model.coefficients.toArray())
    if hasattr(model, "models"):
        parts = [_model_weights(m) for m in model.models]
        if parts and all(p is not None for p in parts):
            return parts[0][0], np.mean([p[1] for p in parts], axis=0)
    return None


def feature_importance(trained: Trained) -> tuple[str, DataFrame]:
    """Importances of the best model and the method that gave them.

    Trees are explained by the mean absolute SHAP values of ``EXPLAINED_ROWS`` rows of the hold-out, chosen by hash.
    """
    spark = trained.train.sparkSession
    if hasattr(trained.best.model, "featureImportances"):
        few = trained.valid.orderBy(F.xxhash64(vector_to_array("features")), "label").limit(EXPLAINED_ROWS)
        # One row per feature; taken now, since the hold-out may be released before the result is read.
        found = mean_abs_shap(few, trained.best.model, trained.names).collect()
        return "shap", spark.createDataFrame(found, IMPORTANCE_SCHEMA)
    found = _model_weights(trained.best.model)
    if found is None:
        return "permutation", permutation_importance(trained)
    kind, weights = found
    weights = weights * np.array(_deviations(trained.train))
    rows = [(n, float(w)) for n, w in zip(trained.names, weights)]
    return kind, spark.createDataFrame(rows, IMPORTANCE_SCHEMA)


def top_features(importance: DataFrame, k: int = 15) -> DataFrame:
    """K6: the most important features."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def permutation_importance(trained: Trained, repeats: int = 3, seed: int = 42) -> DataFrame:
    """How much the primary metric of the hold-out drops when a feature is shuffled.

    The hold-out is dealt at random once. Each task then shuffles one feature within its own batches, so all features
    and repeats are scored in a single pass. Forests predict inside the task, which hands out counts and sums only; for
    other models the changed rows go through ``transform``.
    """
    width, spark = len(trained.names), trained.valid.sparkSession
    is_class = trained.problem_type is ProblemType.CLASSIFICATION
    model = trained.best.model
    dealt = trained.valid.select("label", vector_to_array("features").alias("x")).repartition(F.rand(seed))
    forest = forest_of(model, spark)
    if forest is not None:
        cells = dealt.mapInArrow(_shuffled_forest(spark.sparkContext.broadcast(forest), width, repeats, seed, is_class), _SHUFFLED)
        cells = cells.groupBy("feature", "round", "label", "prediction").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    else:
        wide = dealt.mapInPandas(_shuffled_rows(width, repeats, seed), "feature int, round int, label double, x array<double>")
        scored = model.transform(wide.withColumn("features", array_to_vector("x")).drop("x"))
        cells = scored.groupBy("feature", "round", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    if is_class:
        # Read twice: a small table spares a second pass.
        metric = _grouped_f1(written(cells, "cells"))
    elif forest is not None:
        spread = trained.valid.agg(F.var_pop("label")).first()[0]
        metric = cells.select("feature", "round", (F.lit(1.0) - F.try_divide(F.col("squares") / F.col("n"), F.lit(spread))).alias("metric"))
    else:
        y, p = F.col("label"), F.col("prediction")
        metric = scored.groupBy("feature", "round").agg(
            (F.lit(1.0) - F.try_divide(F.avg((y - p) ** 2), F.var_pop(y))).alias("metric")
        )
    # features * repeats + 1 rows.
    rows = metric.collect()
    base = next(r.metric for r in rows if r.feature == -1)
    drops = [
        (name, float(np.mean([base - r.metric for r in rows if r.feature == j])))
        for j, name in enumerate(trained.names)
    ]
    return spark.createDataFrame(drops, IMPORTANCE_SCHEMA)


def _shuffles(base: np.ndarray, repeats: int, rng: np.random.Generator) -> Iterator[tuple[int, int, np.ndarray]]:
    """(feature, round, rows): the rows as they are, then with one feature after the other shuffled."""
    for j in range(-1, base.shape[1]):
        for r in range(repeats if j >= 0 else 1):
            changed = base.copy()
            if j >= 0:
                changed[:, j] = changed[rng.permutation(len(base)), j]
            yield j, r, changed


def _shuffled_rows(width: int, repeats: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        for batch in batches:
            if len(batch) == 0:
                continue
            base = np.vstack(batch["x"].to_numpy())
            for j, r, changed in _shuffles(base, repeats, rng):
                yield pd.DataFrame({"feature": j, "round": r, "label": batch["label"], "x": list(changed)})

    return run


_SHUFFLED = "feature int, round int, label double, prediction double, n bigint, squares double"


def _shuffled_forest(shared, width: int, repeats: int, seed: int, is_class: bool):
    """How many rows of a task have a label and a prediction; of numbers, the sum of the squared errors instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rng = shared.value, np.random.default_rng(seed)
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            base = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            names, code = np.unique(label, return_inverse=True)
            known = forest.leaves(base)
            for j, r, changed in _shuffles(base, repeats, rng):
                told = forest.predict(forest.leaves_without(changed, known, j))
                if is_class:
                    n = np.bincount(code * forest.n_classes + told.astype(np.int64), minlength=len(names) * forest.n_classes)
                    found = [((j, r, float(names[i // forest.n_classes]), float(i % forest.n_classes)), (n[i], 0.0)) for i in np.flatnonzero(n)]
                else:
                    found = [((j, r, 0.0, 0.0), (len(label), ((label - told) ** 2).sum()))]
                for key, more in found:
                    total[key] = total.get(key, 0) + np.array(more, float)
        if total:
            keys, sums = zip(*total), np.array(list(total.values()))
            columns = [*(np.array(x) for x in keys), sums[:, 0].astype(np.int64), sums[:, 1]]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["feature", "round", "label", "prediction", "n", "squares"])

    return run


def _grouped_f1(cells: DataFrame) -> DataFrame:
    keys = ["feature", "round"]
    actual = cells.groupBy(*keys, F.col("label").alias("c")).agg(
        F.sum("n").alias("actual"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"),
    )
    predicted = cells.groupBy(*keys, F.col("prediction").alias("c")).agg(F.sum("n").alias("predicted"))
    f1 = 2 * F.col("hit") / (F.col("actual") + F.coalesce("predicted", F.lit(0)))
    return (
        actual.join(predicted, [*keys, "c"], "left")
        .groupBy(*keys)
        .agg((F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("metric"))
    )


def metric_of(scored: DataFrame, problem_type: ProblemType) -> float:
    if problem_type is ProblemType.CLASSIFICATION:
        return classification_metrics(scored).first().f1_weighted
    return regression_metrics(scored).first().r2


def cluster_profiles(
    df: DataFrame, label: str, columns: Sequence[str] | None = None, k: int = 15
) -> DataFrame:
    """How far apart the clusters lie on each column, in units of its sample deviation."""
    wanted = [c for c in (numeric_columns(df) if columns is None else columns) if c != label]
    if not wanted:
        return df.sparkSession.createDataFrame([], "feature string, spread double")
    cells = [F.struct(F.lit(c).alias("feature"), as_double(df, c).alias("x")) for c in wanted]
    long = df.select(col(label).alias("cluster"), F.explode(F.array(*cells)).alias("cell")).select(
        "cluster", "cell.*"
    )
    # One row per cluster and column, then one per column.
    per_cluster = long.groupBy("feature", "cluster").agg(F.avg("x").alias("mean"))
    overall = long.groupBy("feature").agg(F.avg("x").alias("centre"), F.stddev_samp("x").alias("std"))
    spread = per_cluster.groupBy("feature").agg(
        F.max("mean").alias("high"), F.min("mean").alias("low"), F.count(F.lit(1)).alias("clusters")
    )
    unit = F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0)).otherwise(F.col("std"))
    standardised = (F.col("high") - F.col("centre")) / unit - (F.col("low") - F.col("centre")) / unit
    return (
        spread.join(F.broadcast(overall), "feature")
        .filter("clusters > 1")
        .select("feature", F.abs(standardised).alias("spread"))
        .orderBy(F.desc("spread"), "feature")
        .limit(k)
    )


def projection(df: DataFrame, features: str = "features", label: str = "prediction") -> DataFrame:
    """(x, y, label): the two leading principal components; their sign is arbitrary."""
    lean = df.select(col(features).alias("features"), col(label).alias("label"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(lean)
    xy = vector_to_array("xy")
    return model.transform(lean).select(xy[0].alias("x"), xy[1].alias("y"), "label")


def principal_components(df: DataFrame, k: int = 2, features: str = "features", output: str = "components") -> DataFrame:
    """The k leading principal components of each row."""
    return PCA(k=k, inputCol=features, outputCol=output).fit(df).transform(df)


def sample_explanations(scored: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """The first rows with their prediction, in an explicit order."""
    return scored.orderBy(*[col(c) for c in order_by]).limit(n)


def explain_clusters(trained: Trained, df: DataFrame) -> dict[str, DataFrame]:
    """Profile, sizes, projection and verdict of the best clustering.

    Predictions stay on the rows they belong to, so the profile of the raw columns and the projection of
    the features always speak of the same labels.
    """
    spark = df.sparkSession
    numbers = [c for c in numeric_columns(df) if c not in trained.recipe.drop]
    scored = trained.best.model.transform(trained.recipe.apply(df, keep=tuple(numbers)))
    value = silhouette(scored)
    verdict = spark.createDataFrame([(value,)], "silhouette_sq double").withColumn(
        "verdict", silhouette_verdict(F.col("silhouette_sq"))
    )
    sizes = (
        scored.groupBy(F.col("prediction").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("is_noise", F.col("label") == NOISE)
        .orderBy("label")
    )
    out = {"profile": cluster_profiles(scored, "prediction", numbers), "sizes": sizes, "verdict": verdict}
    if len(trained.names) >= 2:
        out["projection"] = projection(scored)
    return out
