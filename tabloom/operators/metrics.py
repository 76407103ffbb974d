"""Metrics of scored frames (V5-V9, V11, X6): aggregates over (label, prediction)."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import col

NOISE = -1


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction)."""
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V5/V6: accuracy and the F1 score weighted by class size; an undefined class score counts as zero."""
    cells = confusion(df, label, prediction)
    by_class = (
        cells.select(
            F.explode(
                F.array(
                    F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).alias("predicted"),
                             F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                    F.struct(F.col("prediction").alias("c"), F.lit(0).alias("actual"), F.col("n").alias("predicted"),
                             F.lit(0).alias("hit")),
                )
            ).alias("x")
        )
        .select("x.*")
        .groupBy("c")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("actual", "predicted", "hit")])
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("actual") + F.col("predicted")), F.lit(0.0))
    return by_class.agg(
        F.try_divide(F.sum("hit"), F.sum("actual")).alias("accuracy"),
        F.try_divide(F.sum(f1 * F.col("actual")), F.sum("actual")).alias("f1_weighted"),
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V7: mean absolute error, root mean squared error and R2, in one aggregate."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    squared = F.avg((y - p) ** 2)
    return df.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(squared).alias("rmse"),
        (F.lit(1.0) - F.try_divide(squared, F.var_pop(y))).alias("r2"),
    )


def cluster_count(df: DataFrame, label: str = "prediction") -> DataFrame:
    """V9/P10: clusters, noise left out."""
    return without_noise(df, label).agg(F.count_distinct(col(label)).alias("n_clusters"))


def without_noise(df: DataFrame, label: str = "prediction") -> DataFrame:
    """P10: rows whose label is not noise."""
    return df.filter(col(label) != F.lit(NOISE))


def silhouette(
    df: DataFrame, features: str = "features", prediction: str = "prediction", noise_counts: bool = False
) -> float | None:
    """V8: mean silhouette over squared Euclidean distances; None where there is nothing to tell apart.

    Noise is a group of its own, but it does not make a second cluster unless ``noise_counts``. The
    evaluator works from per-cluster sums, so its cost is linear in the rows.
    """
    ends = df.agg(
        F.count_distinct(col(prediction)).alias("n"),
        F.max(col(prediction)).alias("last"),
        F.max((col(prediction) == F.lit(NOISE)).cast("int")).alias("noise"),
    ).first()
    if ends.n < 2 or (ends.n == 2 and ends.noise and not noise_counts):
        return None
    # The evaluator wants labels from zero: noise moves behind the others.
    shifted = F.when(col(prediction) == F.lit(NOISE), F.lit(ends["last"] + 1)).otherwise(col(prediction))
    scored = df.select(col(features).alias("features"), shifted.cast("double").alias("prediction"))
    return float(ClusteringEvaluator().evaluate(scored))


def silhouette_verdict(value: Column) -> Column:
    """Good, moderate or weak separation."""
    return F.when(value >= 0.5, "good").when(value >= 0.25, "moderate").when(value.isNotNull(), "weak")
