"""Profiles that can be stored and merged (R2, A2, A3, A9): moments, extremes and two sketches for each column.

A part is one row for each group and column. Its distinct values are in a HyperLogLog sketch and its numbers in a
quantile sketch, both binary columns that any table format keeps. Parts of batches, windows, days or tables merge
into the profile of all their rows without reading these rows again. Counts, extremes and moments stay exact;
sketches depend on the order of merging within their errors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import NESTED, as_double, col, kinds, numeric_columns

# 2^14 registers: a standard error of 0.8 % of the distinct count.
DISTINCT_BITS = 14
# Items per level: ranks of quantiles are within 0.7 % of the rows, at 99 %.
QUANTILE_SIZE = 400
MOMENTS = ("count", "n_missing", "mean", "m2", "min", "max", "distinct", "quantiles")
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _present(df: DataFrame, name: str, numeric: bool, kind: str) -> Column:
    if numeric:
        return as_double(df, name)
    return F.when(col(name).isNotNull(), F.to_json(F.struct(col(name)))) if kind == NESTED else col(name)


def part_aggregates(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The aggregates of one part, named by position so that they can become rows; see :func:`part_rows`."""
    numbers, known = set(numeric_columns(df)), kinds(df)
    out = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        x = _present(df, c, c in numbers, known[c])
        # A missing value has no hash here: it is no distinct value.
        parts = [F.count(x), F.count(F.lit(1)) - F.count(x)]
        if c in numbers:
            parts += [F.avg(x), F.var_pop(x) * F.count(x), F.min(x), F.max(x)]
        else:
            parts += [F.lit(None).cast("double")] * 4
        parts.append(F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), F.lit(DISTINCT_BITS)))
        sketch = F.when(F.count(x) > 0, F.kll_sketch_agg_double(x, F.lit(QUANTILE_SIZE)))
        parts.append(sketch if c in numbers else F.lit(None).cast("binary"))
        out += [p.alias(f"__{i}_{name}") for p, name in zip(parts, MOMENTS)]
    return out


def part_rows(grouped: DataFrame, keys: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per group and column from the aggregates of :func:`part_aggregates`."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"__{i}_{name}").alias(name) for name in MOMENTS])
        for i, c in enumerate(columns)
    ]
    return grouped.select(*keys, "n_rows", F.explode(F.array(*cells)).alias("cell")).select(
        "*", "cell.*"
    ).drop("cell")


def sketch_profile(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """(by..., n_rows, column, count, n_missing, mean, m2, min, max, distinct, quantiles), one scan of the table.

    NaN counts as missing. Columns other than numbers have null moments and quantiles. Without ``by`` an empty table
    gives one row per column with counts of 0; with ``by`` it gives none. Columns of the table that are named like
    those of the result can be profiled but not be in ``by``.
    """
    wanted = [c for c in (df.columns if columns is None else columns) if c not in by]
    _check_keys(by)
    if not wanted:
        raise ValueError("no column to profile")
    grouped = df.groupBy(*[col(g) for g in by]).agg(*part_aggregates(df, wanted))
    return part_rows(grouped, [col(g) for g in by], wanted)


def _check_keys(by: Sequence[str]) -> None:
    clash = set(by) & {"column", "n_rows", *MOMENTS}
    if clash:
        raise ValueError(f"keys named like columns of a profile: {sorted(clash)}")


def merge_profiles(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of all rows of the parts, for each value of ``by`` and column.

    Sketches are merged on the map side, so a task passes on one for each key and column, however many parts there
    are. Spreads add up from narrow rows: the squares within the parts, and those of their means about the common
    mean. A part without values moves nothing; parts of no rows give no rows.
    """
    _check_keys(by)
    keys = [*by, "column"]
    # The mean is null where there are no numbers, and so is what would be an empty sketch.
    merged = parts.groupBy(*[col(k) for k in keys]).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("count").alias("count"),
        F.sum("n_missing").alias("n_missing"),
        F.try_divide(F.sum(F.col("count") * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), F.col("count")))).alias("mean"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )
    merged = merged.withColumn("quantiles", F.when(F.col("mean").isNotNull(), F.col("quantiles")))
    centre = merged.select(*[col(k).alias(f"__{k}") for k in keys], F.col("mean").alias("__centre"))
    narrow = parts.select(*[col(k) for k in keys], "count", "mean", "m2")
    same = [col(k).eqNullSafe(col(f"__{k}")) for k in keys]
    spread = (
        narrow.join(centre, same)
        .groupBy(*[col(k) for k in keys])
        .agg(F.sum(F.col("m2") + F.col("count") * F.pow(F.col("mean") - F.col("__centre"), F.lit(2))).alias("m2"))
        .select(*[col(k).alias(f"__{k}") for k in keys], "m2")
    )
    return merged.join(spread, same, "left").select(
        *[col(k) for k in by], "n_rows", "column", *[F.col(name) for name in MOMENTS]
    )


def read_profile(profile: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Replace the sketches by what they tell: ``n_unique``, and one column per quantile; ``m2`` becomes ``std``.

    Columns without values have null quantiles, and none distinct; a single value has no deviation.
    """
    wanted = QUARTILES if quantiles is None else quantiles
    filled = F.col("mean").isNotNull()
    keys = [c for c in profile.columns if c not in MOMENTS]
    return profile.select(
        *[col(c) for c in keys],
        "count", "n_missing", "mean",
        F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1))).alias("std"),
        "min", "max",
        F.hll_sketch_estimate("distinct").alias("n_unique"),
        *[
            F.when(filled, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(name)
            for name, p in wanted.items()
        ],
    )
