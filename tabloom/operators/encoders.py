"""Imputation, scaling, encoding and derived features (T1-T7b, T9-T11, T14, T15) as exact expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import as_double, col
from ..functions.scalars import date_parts, safe_ratio
from ..session import cut_lineage
from .correlation import correlated_pairs
from .lookup import BROADCAST_BYTES, lookup_join
from .quantiles import exact_quantiles

MAX_ONEHOT = 20
RANK_ROWS = 1_000_000


# --- imputation -------------------------------------------------------------------------------


def median_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each numeric column."""
    return {c: q[0] for c, q in exact_quantiles(df, (0.5,), columns).items()}


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """The most frequent value of each column as text, the smallest one among equals."""
    if not columns:
        return {}
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    best = (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("rest"), F.col("value"))).alias("best"))
    )
    found = {r.column: r.best.value for r in best.collect()}
    return {c: found.get(c) for c in columns}


def impute(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill the missing values of the named columns."""

    def filled(c: str) -> Column:
        if values.get(c) is None:
            return col(c)
        if isinstance(values[c], float):
            return F.coalesce(as_double(df, c), F.lit(values[c])).alias(c)
        return F.coalesce(col(c).cast("string"), F.lit(values[c])).alias(c)

    return df.select(*[filled(c) for c in df.columns])


# --- scaling ----------------------------------------------------------------------------------


def scaler_values(df: DataFrame, columns: Sequence[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(centre, spread) of each column; a zero spread becomes one."""
    if not columns or method == "none":
        return {}
    if method == "robust":
        found = exact_quantiles(df, (0.25, 0.5, 0.75), columns)
        pairs = {c: (q[1], None if q[0] is None else q[2] - q[0]) for c, q in found.items()}
    else:
        x = {c: as_double(df, c) for c in columns}
        if method == "standard":
            centre, spread = F.avg, F.stddev_pop
        elif method == "minmax":
            centre, spread = F.min, lambda v: F.max(v) - F.min(v)
        else:
            raise ValueError(f"unknown scaling: {method}")
        row = df.agg(
            *[centre(x[c]).alias(f"m{i}") for i, c in enumerate(columns)],
            *[spread(x[c]).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        pairs = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
    return {c: (m if m is not None else 0.0, s if s else 1.0) for c, (m, s) in pairs.items()}


def scale(df: DataFrame, values: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - centre) / spread for the named columns."""

    def scaled(c: str) -> Column:
        if c not in values:
            return col(c)
        centre, spread = values[c]
        return ((as_double(df, c) - F.lit(centre)) / F.lit(spread)).alias(c)

    return df.select(*[scaled(c) for c in df.columns])


# --- encoding ---------------------------------------------------------------------------------


def onehot_levels(df: DataFrame, column: str, max_categories: int = MAX_ONEHOT) -> tuple[list[str], bool]:
    """The categories that get an output of their own, and whether the rest share one.

    Beyond ``max_categories`` the most frequent ones stay (among equals the larger name) and one
    output is left for the others.
    """
    counts = (
        df.select(col(column).cast("string").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Top-k: one row more than fits tells whether a shared output is needed.
    top = [r.value for r in counts.orderBy(F.desc("n"), F.desc("value")).limit(max_categories + 1).collect()]
    if len(top) <= max_categories:
        return sorted(top), False
    return sorted(top[: max_categories - 1]), True


def onehot(df: DataFrame, column: str, levels: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """One 0/1 column per level; a category never seen gets zeros everywhere.

    ``known`` (value, __n) lists the categories seen in training when some of them share an output:
    those outside ``levels`` set ``<column>_infrequent``.
    """
    text = col(column).cast("string")
    flags = [
        F.coalesce((text == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{column}_{v}") for v in levels
    ]
    if known is None:
        return df.select("*", *flags)
    plain = df.withColumn("__category", text)
    listed = known.select(F.col("value").alias("__category"), "__n", F.lit(True).alias("__seen"))
    seen = lookup_join(plain, listed, "__category")
    rare = F.col("__seen").isNotNull() & ~F.col("__category").isin(list(levels))
    return seen.select(
        *[col(c) for c in df.columns],
        *flags,
        F.coalesce(rare.cast("double"), F.lit(0.0)).alias(f"{column}_infrequent"),
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, __n): the non-missing categories of a column as text."""
    return (
        df.select(col(column).cast("string").alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )


def ranked(df: DataFrame, key: str, rows: int | None = None, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Add ``code``: the 0-based position of each row in the order of its unique ``key``.

    A frame counted as small is ranked in one window. A larger one is range-partitioned; the position
    inside a partition comes from the partition itself and is shifted by the sizes of those before it.
    """
    n = df.count() if rows is None else rows
    if n <= rank_rows:
        return df.withColumn("code", (F.row_number().over(Window.orderBy(col(key))) - 1).cast("bigint"))
    parts = math.ceil(n / rank_rows)
    ordered = df.repartitionByRange(parts, col(key)).sortWithinPartitions(col(key))
    # The high bits of this id are the partition, the low 33 bits count its rows in order. Range cuts
    # come from a sample, so the numbered rows are kept rather than computed twice.
    numbered = cut_lineage(ordered.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.withColumn(
        "offset",
        F.coalesce(
            F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).select("__part", "offset")
    # One row per partition.
    return (
        numbered.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn("code", F.col("offset") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id", "__part", "offset")
    )


def ordinal_table(df: DataFrame, column: str, rank_rows: int = RANK_ROWS) -> DataFrame:
    """(value, __n, code): categories coded by their sort order."""
    return ranked(category_counts(df, column), "value", rank_rows=rank_rows)


def ordinal(
    df: DataFrame, column: str, table: DataFrame, output: str | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The code of each value, -1 for one that the table does not have."""
    out = output or f"{column}_code"
    keyed = table.select(F.col("value").alias("__category"), "__n", F.col("code").alias("__code"))
    joined = lookup_join(
        df.withColumn("__category", col(column).cast("string")), keyed, "__category", broadcast_bytes=broadcast_bytes
    )
    return joined.select(
        *[col(c) for c in df.columns], F.coalesce("__code", F.lit(-1)).cast("double").alias(out)
    )


def target_mean_table(df: DataFrame, column: str, label: str, smoothing: float = 10.0) -> DataFrame:
    """(value, __n, code): the mean label of each category, drawn towards the overall mean."""
    labelled = df.select(col(column).cast("string").alias("value"), as_double(df, label).alias("y")).filter(
        F.col("y").isNotNull()
    )
    overall = labelled.agg(F.avg("y").alias("overall"))
    grouped = labelled.filter(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("y").alias("total")
    )
    return grouped.join(F.broadcast(overall)).select(
        "value",
        "__n",
        ((F.col("total") + F.lit(smoothing) * F.col("overall")) / (F.col("__n") + F.lit(smoothing))).alias("code"),
    )


def target_encode(
    df: DataFrame,
    column: str,
    table: DataFrame,
    fallback: float,
    output: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The smoothed mean of each category; unseen and missing ones get ``fallback``."""
    out = output or f"{column}_mean"
    keyed = table.select(F.col("value").alias("__category"), "__n", F.col("code").alias("__code"))
    joined = lookup_join(
        df.withColumn("__category", col(column).cast("string")), keyed, "__category", broadcast_bytes=broadcast_bytes
    )
    return joined.select(*[col(c) for c in df.columns], F.coalesce("__code", F.lit(fallback)).alias(out))


def label_table(df: DataFrame, target: str) -> DataFrame:
    """(value, __n, code): target classes coded by the sort order of their text."""
    from ..plans.heuristics import cast_target_text

    classes = df.select(cast_target_text(df, target).alias("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("__n")
    )
    return ranked(classes, "value")


def encode_label(df: DataFrame, target: str, table: DataFrame, output: str = "label") -> DataFrame:
    """The class code of each row."""
    from ..plans.heuristics import cast_target_text

    keyed = table.select(F.col("value").alias("__category"), "__n", F.col("code").alias("__code"))
    joined = lookup_join(df.withColumn("__category", cast_target_text(df, target)), keyed, "__category")
    return joined.select(*[col(c) for c in df.columns], F.col("__code").cast("double").alias(output))


# --- derived features -------------------------------------------------------------------------


def date_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Five calendar columns per datetime column."""
    parts = [p for c in columns for p in date_parts(col(c), c)]
    return df.select("*", *parts)


def ratio_features(
    df: DataFrame, columns: Sequence[str], above: float = 0.6, pairs: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """A / b for each pair of columns whose absolute correlation exceeds ``above``."""
    chosen = pairs if pairs is not None else [(a, b) for a, b, _ in correlated_pairs(df, columns, above)]
    new = [(a, b) for a, b in chosen if f"{a}_div_{b}" not in df.columns]
    return df.select("*", *[safe_ratio(as_double(df, a), as_double(df, b)).alias(f"{a}_div_{b}") for a, b in new])


def product_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """A * b for each pair."""
    return df.select("*", *[(as_double(df, a) * as_double(df, b)).alias(f"{a}_x_{b}") for a, b in pairs])


def quantile_bins(df: DataFrame, column: str, bins: int = 4, output: str | None = None) -> DataFrame:
    """The quantile bin of each value, counted from 0; a value on an edge belongs to the lower bin."""
    shares = [i / bins for i in range(1, bins)]
    edges = [e for e in exact_quantiles(df, shares, [column])[column] if e is not None]
    x = as_double(df, column)
    above = sum(((x > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return df.withColumn(output or f"{column}_bin", F.when(x.isNotNull(), above))
