"""Exact quantiles with linear interpolation, by one path at any size.

Spark's ``percentile`` is exact but keeps every distinct value of a column in one aggregation buffer. Here a scan takes
sketched quantiles of all columns, which bound each wanted rank; a second one counts the values below and inside
these bounds; where few are left inside they are ranked one by one. Otherwise rounds of counts per bin narrow the bounds
first. Tasks pass on a few counts; no value is shuffled before the last step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import as_double, numeric_columns

# Sketched quantiles of a column, and their accuracy: a rank is off by at most a ten-thousandth of the rows.
CELLS = 128
ACCURACY = 10_000
# Rows of one bin that may be ranked in one task.
RANK_ROWS = 20_000
BINS = 4_096
_TOTAL_BINS = 400_000


@dataclass(frozen=True)
class _Search:
    column: int
    rank: int  # as asked
    rest: int  # within the interval
    low: float
    high: float


_TOP = 1.7976931348623157e308


def _place(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin of x in [low, high]; a range that would overflow is measured in halves."""
    a, b = max(low, -_TOP), min(high, _TOP)
    if max(abs(a), abs(b)) > _TOP / 4:
        x = F.least(F.greatest(x, F.lit(-_TOP)), F.lit(_TOP)) / 2
        a, b = a / 2, b / 2
    if a >= b:
        return F.lit(0)
    return F.least(F.floor((x - F.lit(a)) / F.lit(b - a) * bins).cast("int"), F.lit(bins - 1))


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]] | Callable[[str, int], Sequence[int]],
    rank_rows: int = RANK_ROWS,
    bins: int = BINS,
) -> dict[str, dict[int, float]]:
    """For each named value the values at the given 0-based ranks of its ascending, non-missing rows.

    Ranks may be given as a function of the name and the number of non-missing rows.
    """
    names = list(values)
    data = df.select(*[values[c].cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    x = [F.col(f"x{i}") for i in range(len(names))]
    grid = F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)])
    ends = data.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(x)],
        *[F.min(v).alias(f"lo{i}") for i, v in enumerate(x)],
        *[F.max(v).alias(f"hi{i}") for i, v in enumerate(x)],
        *[F.percentile_approx(v, grid, F.lit(ACCURACY)).alias(f"at{i}") for i, v in enumerate(x)],
    ).first()
    found: dict[str, dict[int, float]] = {c: {} for c in names}
    bounded: list[_Search] = []
    for i, c in enumerate(names):
        n, low, high, at = ends[f"n{i}"], ends[f"lo{i}"], ends[f"hi{i}"], ends[f"at{i}"]
        for rank in sorted(set(ranks(c, n) if callable(ranks) else ranks[c])):
            if not 0 <= rank < n:
                raise ValueError(f"rank {rank} outside a column of {n} values")
            if low == high:
                found[c][rank] = low
            else:
                # The cell of the rank and one more on either side, since the sketch is not exact.
                cell = rank * CELLS // n
                bounded.append(_Search(i, rank, rank, at[cell - 1] if cell else low, at[cell + 2] if cell + 2 <= CELLS else high))
    ready, open_now = [], []
    if bounded:
        keys = list(_intervals(bounded))
        counted = data.agg(
            *[F.count_if(x[c] < F.lit(low)).alias(f"b{k}") for k, (c, low, _) in enumerate(keys)],
            *[F.count_if((x[c] >= F.lit(low)) & (x[c] <= F.lit(high))).alias(f"i{k}") for k, (c, low, high) in enumerate(keys)],
        ).first()
    for s in bounded:
        k = keys.index((s.column, s.low, s.high))
        rest, inside = s.rank - counted[f"b{k}"], counted[f"i{k}"]
        if not 0 <= rest < inside:
            s, rest, inside = _Search(s.column, s.rank, s.rank, ends[f"lo{s.column}"], ends[f"hi{s.column}"]), s.rank, ends[f"n{s.column}"]
        elif s.low == s.high:
            found[names[s.column]][s.rank] = s.low
            continue
        (ready if inside <= rank_rows else open_now).append(_Search(s.column, s.rank, rest, s.low, s.high))
    while open_now:
        narrowed = []
        for before, s, bin_rows in _round(data, x, open_now, bins):
            if s.low == s.high:
                found[names[s.column]][s.rank] = s.low
            elif bin_rows <= rank_rows or (s.low, s.high) == (before.low, before.high):
                # What no bin can part any more are neighbouring numbers, a few values with many copies.
                ready.append(s)
            else:
                narrowed.append(s)
        open_now = narrowed
    for s, value in _finish(data, x, ready):
        found[names[s.column]][s.rank] = value
    return found


def _intervals(searches: list[_Search]) -> dict[tuple, int]:
    return {key: i for i, key in enumerate(dict.fromkeys((s.column, s.low, s.high) for s in searches))}


def _round(data: DataFrame, x: list[Column], searches: list[_Search], bins: int):
    """One narrowing round: each search, the bin that holds its rank, and the rows of that bin."""
    spark = data.sparkSession
    intervals = _intervals(searches)
    bins = max(min(bins, _TOTAL_BINS // len(intervals)), 2)
    cells = [
        F.when(
            (x[c] >= F.lit(low)) & (x[c] <= F.lit(high)),
            F.struct(F.lit(i).alias("i"), _place(x[c], low, high, bins).alias("bin"), x[c].alias("v")),
        )
        for (c, low, high), i in intervals.items()
    ]
    counts = (
        data.select(F.explode(F.array(*cells)).alias("cell"))
        .filter("cell is not null")
        .select("cell.*")
        .groupBy("i", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    # A window over the bins of one interval.
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("bin")))
    wanted = spark.createDataFrame(
        [(intervals[(s.column, s.low, s.high)], j, s.rest) for j, s in enumerate(searches)], "i int, j int, rest long"
    )
    # One row per search.
    hits = running.join(F.broadcast(wanted), "i").filter("upto > rest and upto - n <= rest").collect()
    for r in hits:
        s = searches[r.j]
        yield s, _Search(s.column, s.rank, r.rest - (r.upto - r.n), r.low, r.high), r.n


def _finish(data: DataFrame, x: list[Column], searches: list[_Search]):
    """Rank the rows of the last intervals, one interval per window group."""
    if not searches:
        return
    intervals = _intervals(searches)
    cells = [
        F.when((x[c] >= F.lit(low)) & (x[c] <= F.lit(high)), F.struct(F.lit(i).alias("i"), x[c].alias("v")))
        for (c, low, high), i in intervals.items()
    ]
    counts = (
        data.select(F.explode(F.array(*cells)).alias("cell"))
        .filter("cell is not null")
        .select("cell.*")
        .groupBy("i", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
    wanted = data.sparkSession.createDataFrame(
        [(intervals[(s.column, s.low, s.high)], j, s.rest) for j, s in enumerate(searches)], "i int, j int, rest long"
    )
    for r in running.join(F.broadcast(wanted), "i").filter("upto > rest and upto - n <= rest").collect():
        yield searches[r.j], r.v


def interpolate(n: int, share: float) -> tuple[int, int, float]:
    """The two neighbouring ranks of a quantile and the weight of the upper one."""
    place = share * (n - 1)
    low = math.floor(place)
    return low, min(low + 1, n - 1), place - low


def _mix(low: float, high: float, weight: float) -> float:
    return low if low == high or weight == 0 else low + (high - low) * weight


def narrow_quantiles(
    df: DataFrame, values: Mapping[str, Column], shares: Sequence[float], rank_rows: int = RANK_ROWS, bins: int = BINS
) -> dict[str, list[float | None]]:
    """Quantiles of the named values."""
    places: dict[str, list[tuple[int, int, float]]] = {}

    def ranks(name: str, n: int) -> list[int]:
        places[name] = [interpolate(n, s) for s in shares] if n else []
        return [r for low, high, _ in places[name] for r in (low, high)]

    at = order_statistics(df, values, ranks, rank_rows, bins) if values else {}
    return {
        c: [_mix(at[c][low], at[c][high], w) for low, high, w in places[c]] if places[c] else [None] * len(shares)
        for c in values
    }


def quantile_columns(df: DataFrame, shares: Sequence[float], columns: Sequence[str] | None = None) -> dict[str, Column]:
    """For each numeric column an expression: ARRAY of its quantiles, which are computed at once."""
    found = exact_quantiles(df, shares, columns)
    return {c: F.array(*[F.lit(v).cast("double") for v in q]) for c, q in found.items()}


def exact_quantiles(
    df: DataFrame, shares: Sequence[float], columns: Sequence[str] | None = None
) -> dict[str, list[float | None]]:
    """Quantiles of numeric columns as driver values: a handful of numbers per column."""
    wanted = list(numeric_columns(df) if columns is None else columns)
    return narrow_quantiles(df, {c: as_double(df, c) for c in wanted}, shares)
