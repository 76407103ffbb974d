"""Profile facets (A1-A8, A10-A16, K1-K3): each one is a long DataFrame with fixed column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import (
    BOOLEAN,
    CATEGORICAL,
    DATETIME,
    NESTED,
    NUMERIC,
    as_double,
    col,
    columns_of,
    kinds,
    normalize,
    numeric_columns,
    plan_numeric_columns,
)
from ..functions.scalars import share
from ..session import written
from .lookup import BROADCAST_BYTES
from .quantiles import exact_quantiles, quantile_columns
from .tally import TableTally, tally_frame

HIGH_CARDINALITY = 50
IMBALANCE_LIMIT = 5.0


def _rows(df: DataFrame, structs: Sequence[Column], schema: str) -> DataFrame:
    """One aggregated row of structs turned into one output row per struct."""
    if not structs:
        return df.sparkSession.createDataFrame([], schema)
    return df.agg(F.array(*structs).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def shape(df: DataFrame) -> DataFrame:
    """A1: row count, column count and columns per kind."""
    found = list(kinds(df).values())
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(found)).alias("n_columns"),
        *[F.lit(found.count(k)).alias(f"n_{k}") for k in (NUMERIC, CATEGORICAL, DATETIME, BOOLEAN, NESTED)],
    )


def column_info(df: DataFrame) -> DataFrame:
    """Type, kind, distinct and missing counts and the smallest value of each column as its example."""
    examples = [
        F.struct(
            F.lit(c).alias("column"),
            (F.min(as_double(df, c)) if k == NUMERIC and _is_real(df, c) else F.min(_comparable(df, c)))
            .cast("string")
            .alias("example"),
        )
        for c, k in kinds(df).items()
    ]
    example = _rows(df, examples, "column string, example string")
    # Both sides have one row per column of the table.
    return (
        tally_frame(df)
        .join(F.broadcast(example), "column", "left")
        .select(
            "position",
            "column",
            "dtype",
            F.when(F.col("kind") == BOOLEAN, NUMERIC).otherwise(F.col("kind")).alias("kind"),
            "n_unique",
            "n_missing",
            "example",
        )
    )


def _is_real(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() in ("float", "double")


def _comparable(df: DataFrame, name: str) -> Column:
    c = col(name)
    if kinds(df)[name] == NESTED:
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return c


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A2: count, mean, sample deviation, extremes and quartiles of each numeric column."""
    wanted = list(numeric_columns(df) if columns is None else columns)
    quartiles = quantile_columns(df, (0.25, 0.5, 0.75), wanted)
    structs = []
    for c in wanted:
        x = as_double(df, c)
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                quartiles[c][0].alias("q25"),
                quartiles[c][1].alias("q50"),
                quartiles[c][2].alias("q75"),
                F.max(x).alias("max"),
            )
        )
    return _rows(
        df,
        structs,
        "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double",
    )


def _missing_test(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c.isNull() | F.isnan(c)) if _is_real(df, name) else c.isNull()


def missing(df: DataFrame) -> DataFrame:
    """A3: columns that have missing values, with count and share."""
    structs = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.count_if(_missing_test(df, c)).alias("n_missing"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        for i, c in enumerate(df.columns)
    ]
    return (
        _rows(df, structs, "position int, column string, n_missing long, n_rows long")
        .filter(F.col("n_missing") > 0)
        .select("position", "column", "n_missing", share(F.col("n_missing"), F.col("n_rows")).alias("ratio"))
    )


def missing_totals(df: DataFrame) -> DataFrame:
    """Missing cells and complete rows of the table."""
    tests = [_missing_test(df, c) for c in df.columns]
    gaps = sum((t.cast("int") for t in tests), F.lit(0))
    return df.agg(
        F.coalesce(F.sum(gaps), F.lit(0)).cast("long").alias("total_missing"),
        F.count_if(gaps == 0).alias("complete_rows"),
    )


def complete_rows(df: DataFrame) -> DataFrame:
    """The rows without any missing value."""
    return normalize(df).na.drop("any")


def top_missing(df: DataFrame, k: int = 3) -> DataFrame:
    """K2: the columns with most missing values."""
    return missing(df).orderBy(F.desc("n_missing"), "position").limit(k).drop("position")


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of the whole row; which of its values are missing counts too."""
    values = [col(c) for c in df.columns]
    # A hash passes over nulls, so (null, a) and (a, null) are told apart by their gaps.
    gaps = [v.isNull() for v in values]
    return [F.xxhash64(F.lit(salt), *values, *gaps).alias(f"__print{salt}") for salt in (1, 2)]


def duplicate_count(df: DataFrame, tally: TableTally | None = None, fingerprint: bool | None = None) -> DataFrame:
    """A4: rows beyond the first of each group of identical rows; missing equals missing.

    A column known to hold a different value in every row settles the question without a shuffle.
    Otherwise identical rows are combined where they are read and each distinct row is shuffled once: as 16 bytes
    of fingerprint where rows may be long (text, binary or nested columns, or ``fingerprint=True``). Only rows whose
    fingerprint occurs twice or more are then compared whole, so the count is exact; if more fingerprints are shared
    than ``BROADCAST_BYTES`` holds, all rows are compared.
    """
    if tally is not None and any(c.exact and c.n_rows and c.n_unique == c.n_rows for c in tally.columns):
        return _no_duplicates(df)
    plain = normalize(df)
    plain = plain.select(
        *[
            F.to_json(F.struct(col(c))).alias(c) if plain.schema[c].dataType.typeName() == "map" else col(c)
            for c in plain.columns
        ]
    )
    known = set(kinds(plain).values())
    # Names by position clash neither with the fingerprint's nor with each other.
    plain = plain.toDF(*[f"c{i}" for i in range(len(plain.columns))])
    if (known & {CATEGORICAL, NESTED}) if fingerprint is None else fingerprint:
        prints = plain.groupBy(*row_fingerprint(plain)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        shared = written(prints.drop("n"), "fingerprints")
        n_shared = shared.count()
        if not n_shared:
            return _no_duplicates(df)
        if n_shared * 2 * 8 <= BROADCAST_BYTES:
            marked = plain.select("*", *row_fingerprint(plain))
            plain = marked.join(F.broadcast(shared), shared.columns, "left_semi").drop(*shared.columns)
    return (
        plain.groupBy(*[col(c) for c in plain.columns])
        .agg(F.count(F.lit(1)).alias("__copies"))
        .agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("n_duplicates"))
    )


def _no_duplicates(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_duplicates"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows per target value, missing as its own value."""
    counts = normalize(df.select(col(target))).groupBy(col(target).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", share(F.col("n"), F.col("total")).alias("share"))


def class_balance_summary(df: DataFrame, target: str) -> DataFrame:
    """Class count, majority share, and majority to minority ratio with its flag."""
    counts = normalize(df.select(col(target))).groupBy(col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.try_divide(F.max("n").cast("double"), F.min("n").cast("double"))
    return counts.agg(
        F.lit(target).alias("target"),
        F.count(F.lit(1)).alias("n_classes"),
        F.round(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(1.0)), 4).alias("imbalance_ratio"),
        F.round(ratio, 4).alias("majority_minority_ratio"),
        F.coalesce((ratio > IMBALANCE_LIMIT) & (F.count(F.lit(1)) > 1), F.lit(False)).alias("is_imbalanced"),
    )


def target_distribution(df: DataFrame, target: str, k: int = 20) -> DataFrame:
    """The most frequent target values."""
    return class_balance(df, target).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def _text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Distinct count, cardinality class and the k most frequent values of each text column.

    The rank filter becomes a group limit below the shuffle, so each task passes on at most k values
    per column however many there are.
    """
    wanted = list(columns_of(df, CATEGORICAL) if columns is None else columns)
    if not wanted:
        return df.sparkSession.createDataFrame(
            [], "column string, n_unique long, cardinality string, rank int, value string, n long"
        )
    counts = _text_counts(df, wanted)
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # At most one row per column of the table.
    return top.join(F.broadcast(sizes), "column").select(
        "column",
        "n_unique",
        F.when(F.col("n_unique") > HIGH_CARDINALITY, "high").otherwise("low").alias("cardinality"),
        "rank",
        "value",
        "n",
    )


def outlier_bounds(df: DataFrame, columns: Sequence[str] | None = None):
    """Interquartile fences per numeric column: {column: (lower, upper)}."""
    fences = {}
    for c, (q1, q3) in exact_quantiles(df, (0.25, 0.75), columns).items():
        if q1 is not None:
            fences[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return fences


def is_outlier(df: DataFrame, name: str, bounds: tuple[float, float]) -> Column:
    """P5: outside the fences."""
    x = as_double(df, name)
    return (x < F.lit(bounds[0])) | (x > F.lit(bounds[1]))


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns with values outside the fences; the share is of all rows."""
    fences = outlier_bounds(df, columns)
    structs = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.count_if(is_outlier(df, c, b)).alias("n_outliers"),
            share(F.count_if(is_outlier(df, c, b)), F.count(F.lit(1))).alias("ratio"),
            F.lit(b[0]).alias("lower_bound"),
            F.lit(b[1]).alias("upper_bound"),
        )
        for i, (c, b) in enumerate(fences.items())
    ]
    return _rows(
        df,
        structs,
        "position int, column string, n_outliers long, ratio double, lower_bound double, upper_bound double",
    ).filter(F.col("n_outliers") > 0)


def outlier_rows(df: DataFrame, name: str) -> DataFrame:
    """P5: the rows outside the fences of one column."""
    fences = outlier_bounds(df, [name])
    return df.filter(is_outlier(df, name, fences[name])) if name in fences else df.limit(0)


def top_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """K3: the columns with most outliers."""
    return outliers(df, columns).orderBy(F.desc("n_outliers"), "position").limit(k).drop("position")


def boxplots(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Five numbers and whisker ends (the last values inside the fences) of numeric columns."""
    wanted = list(numeric_columns(df) if columns is None else columns)
    quartiles = exact_quantiles(df, (0.25, 0.5, 0.75), wanted)
    structs = []
    for c in wanted:
        q1, q2, q3 = quartiles[c]
        if q1 is None:
            continue
        x = as_double(df, c)
        inside = F.when(~is_outlier(df, c, (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))), x)
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.min(x).alias("min"),
                F.min(inside).alias("whisker_low"),
                F.lit(q1).alias("q25"),
                F.lit(q2).alias("q50"),
                F.lit(q3).alias("q75"),
                F.max(inside).alias("whisker_high"),
                F.max(x).alias("max"),
            )
        )
    return _rows(
        df,
        structs,
        "column string, min double, whisker_low double, q25 double, q50 double, q75 double, "
        "whisker_high double, max double",
    )


def histograms(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20
) -> DataFrame:
    """Equal-width bins between the extremes of numeric columns; empty bins are left out."""
    wanted = list(numeric_columns(df) if columns is None else columns)
    if not wanted:
        return df.sparkSession.createDataFrame([], "column string, bin int, lower double, upper double, n long")
    ends = df.agg(
        *[F.min(as_double(df, c)).alias(f"lo{i}") for i, c in enumerate(wanted)],
        *[F.max(as_double(df, c)).alias(f"hi{i}") for i, c in enumerate(wanted)],
    ).first()
    cells = []
    for i, c in enumerate(wanted):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        if low is None:
            continue
        width = (high - low) / bins or 1.0
        x = as_double(df, c)
        place = F.least(F.floor((x - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                place.alias("bin"),
                F.lit(low).alias("low"),
                F.lit(width).alias("width"),
            )
        )
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bin int, lower double, upper double, n long")
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin", "low", "width")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column",
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("lower"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
            "n",
        )
    )


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """A10: mean, median and sample deviation of a numeric target."""
    x = as_double(df, target)
    median = quantile_columns(df, (0.5,), [target])[target][0]
    return df.agg(
        F.lit(target).alias("target"),
        F.avg(x).alias("mean"),
        median.alias("median"),
        F.stddev_samp(x).alias("std"),
    )


def target_top_values(df: DataFrame, target: str, k: int = 5) -> DataFrame:
    """The most frequent non-missing target values."""
    return (
        normalize(df.select(col(target)))
        .filter(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
    )


def group_means(df: DataFrame, group: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of each numeric column within each group."""
    wanted = [c for c in (numeric_columns(df) if columns is None else columns) if c != group]
    return df.groupBy(col(group)).agg(*[F.avg(as_double(df, c)).alias(c) for c in wanted])


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Rows per label, ordered by label."""
    return df.groupBy(col(group)).agg(F.count(F.lit(1)).alias("n")).orderBy(col(group))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 8) -> DataFrame:
    """The first rows in an explicit order; a top-k, never a full sort."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def constant_columns(tally: TableTally) -> list[str]:
    """Columns with at most one distinct value."""
    return [c.name for c in tally.columns if c.n_unique <= 1]


def fill_zero(df: DataFrame) -> DataFrame:
    """Zero for every missing number."""
    return normalize(df).na.fill(0)


def planning_numeric(df: DataFrame) -> DataFrame:
    """The columns that planning rules call numeric."""
    return df.select(*[col(c) for c in plan_numeric_columns(df)])
