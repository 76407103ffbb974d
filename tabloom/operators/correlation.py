"""Pairwise-complete Pearson correlation (A5, K1)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, numeric_columns

PAIRS_PER_PASS = 200


def _typical(df: DataFrame, columns: Sequence[str]) -> tuple[list[float], set[str]]:
    """The mean of each column, and the columns that have missing values."""
    row = df.agg(
        *[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[(F.count(F.lit(1)) - F.count(as_double(df, c))).alias(f"g{i}") for i, c in enumerate(columns)],
    ).first()
    means = [row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(len(columns))]
    return means, {c for i, c in enumerate(columns) if row[f"g{i}"]}


def correlations(df: DataFrame, columns: Sequence[str] | None = None, wide_above: int = PAIRS_PER_PASS) -> DataFrame:
    """A5: (a, b, corr, n) for every numeric pair, a before b in column order; NULL where one side is constant.

    A first pass takes the means, so that the second one can sum plain products of centred values. Narrow
    tables sum them in one generated aggregate; wide ones as matrix products of blocks, still in one scan.
    """
    wanted = list(numeric_columns(df) if columns is None else columns)
    pairs = [(a, b) for i, a in enumerate(wanted) for b in wanted[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double, n long")
    means, gappy = _typical(df, wanted)
    if len(pairs) > wide_above:
        return _from_sums(_block_sums(df, wanted, means), wanted)
    names = {c: f"x{i}" for i, c in enumerate(wanted)}
    centred = df.select(*[(as_double(df, c) - F.lit(m)).alias(names[c]) for c, m in zip(wanted, means)])
    # Sums over one column are shared by all its pairs unless a partner has gaps.
    cells = []
    for a, b in pairs:
        x, y = F.col(names[a]), F.col(names[b])
        left = F.when(y.isNotNull(), x) if b in gappy else x
        right = F.when(x.isNotNull(), y) if a in gappy else y
        cells.append(
            F.struct(
                F.lit(wanted.index(a)).alias("i"),
                F.lit(wanted.index(b)).alias("j"),
                F.count(left if b in gappy or a in gappy else F.lit(1)).cast("double").alias("n"),
                F.sum(left).alias("sa"),
                F.sum(right).alias("sb"),
                F.sum(left * left).alias("qa"),
                F.sum(right * right).alias("qb"),
                F.sum(x * y).alias("ab"),
            )
        )
    sums = centred.agg(F.array(*cells).alias("all")).select(F.explode("all").alias("one")).select("one.*")
    return _from_sums(sums, wanted)


def _from_sums(sums: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations from the summed moments of centred values."""
    n, sa, sb, qa, qb, ab = (F.col(c) for c in ("n", "sa", "sb", "qa", "qb", "ab"))
    spread_a, spread_b = n * qa - sa * sa, n * qb - sb * sb
    # Rounding leaves a constant column a tiny spread; relative to its square sum that is no variation.
    varies = (spread_a > 1e-12 * n * qa) & (spread_b > 1e-12 * n * qb)
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.element_at(names, F.col("i") + 1).alias("a"),
        F.element_at(names, F.col("j") + 1).alias("b"),
        F.when(varies, F.try_divide(n * ab - sa * sb, F.sqrt(spread_a) * F.sqrt(spread_b))).alias("corr"),
        n.cast("long").alias("n"),
    )


def _block_sums(df: DataFrame, columns: list[str], means: list[float]) -> DataFrame:
    """One scan: each task sums products of its blocks and passes on one row per pair."""
    shift = np.array(means)
    upper = np.triu_indices(len(columns), 1)

    def moments(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for block in blocks:
            values = block.to_numpy(dtype=float)
            known = ~np.isnan(values)
            filled = np.where(known, values - shift, 0.0)
            mask = known.astype(float)
            part = np.stack(
                [mask.T @ mask, filled.T @ mask, mask.T @ filled, (filled**2).T @ mask, mask.T @ (filled**2),
                 filled.T @ filled]
            )
            total = part if total is None else total + part
        if total is not None:
            picked = total[:, upper[0], upper[1]]
            yield pd.DataFrame(
                {"i": upper[0], "j": upper[1], "n": picked[0], "sa": picked[1], "sb": picked[2],
                 "qa": picked[3], "qb": picked[4], "ab": picked[5]}
            )

    plain = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    sums = plain.mapInPandas(
        moments, "i int, j int, n double, sa double, sb double, qa double, qb double, ab double"
    )
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")])


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A5: the full matrix in long form, both directions and the diagonal."""
    wanted = list(numeric_columns(df) if columns is None else columns)
    pairs = correlations(df, wanted).select("a", "b", "corr")
    flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    spread = [
        F.struct(
            F.lit(c).alias("a"),
            F.lit(c).alias("b"),
            F.when(F.stddev_pop(as_double(df, c)) > 0, F.lit(1.0)).alias("corr"),
        )
        for c in wanted
    ]
    diagonal = df.agg(F.array(*spread).alias("all")).select(F.explode("all").alias("one")).select("one.*")
    return pairs.unionByName(flipped).unionByName(diagonal)


def top_pairs(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """K1: the pairs with the largest absolute correlation."""
    return (
        correlations(df, columns)
        .filter(F.col("corr").isNotNull())
        .orderBy(F.desc(F.abs("corr")), "a", "b")
        .limit(k)
    )


def correlated_pairs(df: DataFrame, columns: Sequence[str], above: float) -> list[tuple[str, str, float]]:
    """Pairs above an absolute correlation, in column order: at most one per pair of columns."""
    order = {c: i for i, c in enumerate(columns)}
    rows = correlations(df, columns).filter(F.abs("corr") > above).collect()
    return sorted(((r.a, r.b, r.corr) for r in rows), key=lambda t: (order[t[0]], order[t[1]]))
