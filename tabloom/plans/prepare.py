"""From a plan to model input (T8, T12, P8, X8): fitted on training rows, applied to any rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VarianceThresholdSelector, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import DATETIME, as_double, col, columns_of, drop_columns, kind_of, kinds, normalize
from ..functions.kinds import BOOLEAN, NESTED, NUMERIC
from ..operators.correlation import correlated_pairs
from ..operators.encoders import (
    category_counts,
    date_features,
    label_table,
    median_values,
    mode_values,
    onehot_levels,
    ordinal_table,
    ratio_features,
    scaler_values,
    target_mean_table,
)
from ..operators.lookup import lookup_join, measured_bytes
from ..session import written
from .heuristics import Plan

RATIO_CORRELATION = 0.6


@dataclass
class CategoryStep:
    column: str
    encoder: str
    mode: str | None
    levels: list[str] = field(default_factory=list)
    shared: bool = False
    fallback: float = -1.0
    table_bytes: int = 0


@dataclass
class Recipe:
    """Fitted preparation: small numbers per column, plus one lookup table per wide category column."""

    drop: list[str]
    dates: list[str]
    ratio_pairs: list[tuple[str, str]]
    numeric: list[str]
    medians: dict[str, float]
    scaling: dict[str, tuple[float, float]]
    categories: list[CategoryStep]
    kept: list[int] | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def all_names(self) -> list[str]:
        names = list(self.numeric)
        for step in self.categories:
            if step.encoder == "onehot":
                names += [f"{step.column}_{v}" for v in step.levels]
                names += [f"{step.column}_infrequent"] if step.shared else []
            else:
                names.append(step.column)
        return names

    @property
    def feature_names(self) -> list[str]:
        """Names of the vector's entries."""
        names = self.all_names
        return names if self.kept is None else [names[i] for i in self.kept]

    def derive(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Raw columns to planned columns: drops (but for ``keep``), calendar parts, ratios."""
        plain = drop_columns(normalize(df), [c for c in self.drop if c not in keep])
        plain = date_features(plain, [c for c in self.dates if c in plain.columns])
        return ratio_features(plain, (), pairs=self.ratio_pairs)

    def apply(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Add the vector ``features``; of the other columns only ``keep`` stay."""
        plain = self.derive(df, keep)
        kept = [c for c in keep if c in plain.columns]
        values = [col(c) for c in kept]
        for i, c in enumerate(self.numeric):
            filled = F.coalesce(as_double(plain, c), F.lit(self.medians.get(c, 0.0)))
            centre, spread = self.scaling.get(c, (0.0, 1.0))
            values.append(((filled - F.lit(centre)) / F.lit(spread)).alias(f"__n{i}"))
        lookups = []
        for i, step in enumerate(self.categories):
            text = F.coalesce(col(step.column).cast("string"), F.lit(step.mode))
            if step.encoder == "onehot":
                for j, v in enumerate(step.levels):
                    values.append(F.coalesce((text == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"__c{i}_{j}"))
            if step.encoder != "onehot" or step.shared:
                values.append(text.alias(f"__c{i}"))
                lookups.append((i, step))
        out = plain.select(*values)
        for i, step in lookups:
            table = self.tables[step.column].select(
                F.col("value").alias(f"__c{i}"), "__n", F.col("code").cast("double").alias(f"__code{i}")
            )
            out = lookup_join(out, table, f"__c{i}", step.table_bytes)
            if step.encoder == "onehot":
                rare = F.col(f"__code{i}").isNotNull() & ~F.col(f"__c{i}").isin(step.levels)
                out = out.withColumn(f"__c{i}_{len(step.levels)}", F.coalesce(rare.cast("double"), F.lit(0.0)))
            else:
                out = out.withColumn(f"__code{i}", F.coalesce(f"__code{i}", F.lit(step.fallback)))
        inputs = self._inputs()
        if self.kept is not None:
            inputs = [inputs[i] for i in self.kept]
        assembled = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(out)
        return assembled.select(*[col(c) for c in kept], "features")

    def _inputs(self) -> list[str]:
        names = [f"__n{i}" for i in range(len(self.numeric))]
        for i, step in enumerate(self.categories):
            if step.encoder == "onehot":
                names += [f"__c{i}_{j}" for j in range(len(step.levels) + int(step.shared))]
            else:
                names.append(f"__code{i}")
        return names

    def save(self, spark: SparkSession, path: str) -> None:
        state = {k: v for k, v in self.__dict__.items() if k not in ("categories", "tables")}
        state["categories"] = [s.__dict__ for s in self.categories]
        state["table_columns"] = list(self.tables)
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/recipe")
        for i, table in enumerate(self.tables.values()):
            table.write.parquet(f"{path}/tables/{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Recipe":
        state = json.loads(spark.read.text(f"{path}/recipe").first().value)
        columns = state.pop("table_columns")
        state["categories"] = [CategoryStep(**s) for s in state["categories"]]
        state["ratio_pairs"] = [tuple(p) for p in state["ratio_pairs"]]
        state["scaling"] = {c: tuple(v) for c, v in state["scaling"].items()}
        tables = {c: spark.read.parquet(f"{path}/tables/{i}") for i, c in enumerate(columns)}
        return Recipe(**state, tables=tables)


def _category_step(
    df: DataFrame, column: str, encoder: str, mode: str | None, label: str | None, tables: dict[str, DataFrame]
) -> CategoryStep | None:
    filled = df.withColumn(column, F.coalesce(col(column).cast("string"), F.lit(mode)))
    if encoder == "onehot":
        levels, shared = onehot_levels(filled, column)
        step = CategoryStep(column, encoder, mode, levels, shared)
        if shared:
            tables[column] = written(category_counts(filled, column).withColumn("code", F.lit(1.0)), "levels")
    elif encoder == "target" and label is not None:
        tables[column] = written(target_mean_table(filled, column, label), "means")
        overall = df.agg(F.avg(as_double(df, label)).alias("m")).first().m
        step = CategoryStep(column, encoder, mode, fallback=overall if overall is not None else 0.0)
    elif encoder in ("ordinal", "target"):
        tables[column] = written(ordinal_table(filled, column), "codes")
        step = CategoryStep(column, "ordinal", mode)
    else:
        return None
    if column in tables:
        step.table_bytes = measured_bytes(tables[column])
    return step


def fit_recipe(
    df: DataFrame, plan: Plan, target: str | None = None, label: str | None = None, exclude: tuple[str, ...] = ()
) -> Recipe:
    """Fit the plan on ``df``; the target and the columns in ``exclude`` never become features.

    ``label`` names the numeric label used for target means; without it those columns get rank codes.
    Ratio pairs are chosen here, on the rows given, so hold-out rows have no say.
    """
    drop = [*plan.drop, *([target] if target else []), *exclude]
    raw = drop_columns(df, [c for c in drop if c != label])
    nested = [c for c in columns_of(raw, NESTED) if c != label]
    drop += nested
    recipe = Recipe(
        drop=drop,
        dates=[c for c in plan.date_features if c not in drop],
        ratio_pairs=[],
        numeric=[],
        medians={},
        scaling={},
        categories=[],
    )
    own = () if label is None else (label,)
    plain = recipe.derive(df, own)
    if plan.ratios:
        numbers = [c for c, k in kinds(plain).items() if k == NUMERIC and c != label]
        recipe.ratio_pairs = [(a, b) for a, b, _ in correlated_pairs(plain, numbers, RATIO_CORRELATION)]
        plain = recipe.derive(df, own)
    for c, kind in kinds(plain).items():
        if c != label and kind in (NUMERIC, BOOLEAN):
            recipe.numeric.append(c)
    texts = [c for c in plain.columns if c != label and c not in recipe.numeric]
    medians = median_values(plain, recipe.numeric)
    recipe.medians = {c: v if v is not None else 0.0 for c, v in medians.items()}
    filled = plain.select(
        *[F.coalesce(as_double(plain, c), F.lit(recipe.medians[c])).alias(c) for c in recipe.numeric]
    )
    recipe.scaling = scaler_values(filled, recipe.numeric, plan.scaling)
    modes = mode_values(plain, texts)
    for c in texts:
        encoder = plan.encoders.get(c, "onehot" if kind_of(plain.schema[c].dataType) != DATETIME else "ordinal")
        step = _category_step(plain, c, encoder, modes[c], label, recipe.tables)
        if step is not None:
            recipe.categories.append(step)
    if not recipe.all_names:
        raise ValueError("the plan leaves no feature column")
    if plan.reduction == "variance":
        recipe.kept = varying_features(recipe.apply(df))
    return recipe


def varying_features(df: DataFrame, features: str = "features") -> list[int]:
    """Positions of the vector entries that vary."""
    selector = VarianceThresholdSelector(varianceThreshold=0.0, featuresCol=features, outputCol="__kept")
    return [int(i) for i in selector.fit(df).selectedFeatures]


def label_frame(df: DataFrame, target: str, n_unique: int) -> tuple[DataFrame, DataFrame | None]:
    """Add ``label``: the class code of text or few-valued targets, else the number itself.

    Also returns the class table, or None for a plain number. Rows without a number are left out.
    """
    from ..operators.encoders import encode_label

    kind = kind_of(df.schema[target].dataType)
    if kind not in (NUMERIC, BOOLEAN) or n_unique <= 20:
        classes = written(label_table(df, target), "classes")
        return encode_label(df, target, classes), classes
    return df.withColumn("label", as_double(df, target)).filter(F.col("label").isNotNull()), None
