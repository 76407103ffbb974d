"""Time steps of datetime columns.

The step between consecutive timestamps needs a global order, which a plain ``lag`` window would put
into a single task. Here equal timestamps are combined first (they only add zero steps), the distinct
ones are cut into ranges of bounded size, ``lag`` runs inside each range, and the first step of a range
is taken from the previous range's last timestamp.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import DATETIME, col, columns_of
from ..functions.scalars import epoch_micros, from_epoch_micros, iso_text
from .quantiles import RANK_ROWS, interpolate, order_statistics

RANGE_ROWS = 1_000_000


def _ranged(distinct: DataFrame, n_distinct: int, range_rows: int) -> tuple[DataFrame, int]:
    """Add ``part``: the ordered range a timestamp falls in, balanced by sketched quantiles."""
    parts = max(math.ceil(n_distinct / range_rows), 1)
    if parts == 1:
        return distinct.withColumn("part", F.lit(0.0)), 1
    shares = [i / parts for i in range(1, parts)]
    cuts = distinct.agg(F.percentile_approx("ts", shares, 10 * parts).alias("cuts")).first().cuts
    splits = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol="seconds", outputCol="part")
    placed = bucketizer.transform(distinct.withColumn("seconds", F.col("ts").cast("double")))
    return placed.drop("seconds"), len(splits) - 1


def steps(
    df: DataFrame,
    column: str,
    partition_by: Sequence[str] = (),
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(…keys, ts, step_s, n_zero): each distinct timestamp, the seconds since the one before it,
    and how many repeats of it add a zero step.

    With ``partition_by`` the steps run within each key combination.
    """
    keys = [col(c) for c in partition_by]
    present = df.select(*keys, epoch_micros(col(column)).alias("ts")).filter(F.col("ts").isNotNull())
    distinct = present.groupBy(*keys, "ts").agg((F.count(F.lit(1)) - 1).alias("n_zero"))
    n_distinct = distinct.count() if df.count() > range_rows else 0
    placed, parts = _ranged(distinct, n_distinct, range_rows)
    order = Window.partitionBy(*keys, "part").orderBy("ts")
    inner = placed.withColumn("before", F.lag("ts").over(order))
    if parts > 1:
        # One row per key and range; joined with the start of the next range of the same key.
        ends = placed.groupBy(*keys, "part").agg(F.max("ts").alias("last"), F.min("ts").alias("first"))
        chain = Window.partitionBy(*keys).orderBy("part") if partition_by else Window.orderBy("part")
        starts = ends.select(
            *[k.alias(f"__k{i}") for i, k in enumerate(keys)],
            F.col("first"),
            F.lag("last").over(chain).alias("previous"),
        )
        same = [inner[c].eqNullSafe(starts[f"__k{i}"]) for i, c in enumerate(partition_by)]
        condition = F.col("ts") == F.col("first")
        for test in same:
            condition = condition & test
        # Without keys there is one row per range, a millionth of the distinct timestamps.
        side = starts if partition_by else F.broadcast(starts)
        inner = inner.join(side, condition, "left").withColumn("before", F.coalesce("before", "previous"))
    return inner.select(
        *keys,
        from_epoch_micros(F.col("ts"), df.schema[column].dataType.typeName() == "timestamp").alias("ts"),
        ((F.col("ts") - F.col("before")) / F.lit(1e6)).alias("step_s"),
        "n_zero",
    )


def _step_summary(every: DataFrame, n_steps: int, mean: float, rank_rows: int) -> tuple[float, float]:
    """Sum of squared distances from the mean step, and the median step; repeats are steps of zero."""
    every = every.persist()
    try:
        sums = every.agg(
            F.sum("n_zero").alias("n_zero"), F.sum((F.col("step_s") - F.lit(mean)) ** 2).alias("squares")
        ).first()
        moves = every.filter(F.col("step_s").isNotNull())
        low, high, weight = interpolate(n_steps, 0.5)
        ranks = [r - sums.n_zero for r in (low, high) if r >= sums.n_zero]
        at = order_statistics(moves, {"s": F.col("step_s")}, {"s": ranks}, rank_rows)["s"] if ranks else {}
    finally:
        every.unpersist()
    a, b = (0.0 if r < sums.n_zero else at[r - sums.n_zero] for r in (low, high))
    return (sums.squares or 0.0) + sums.n_zero * mean**2, a + (b - a) * weight


def temporal_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    range_rows: int = RANGE_ROWS,
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """H8: extent, median step and regularity of each datetime column.

    Regular means: the sample deviation of the steps stays below a tenth of the absolute median step
    (a zero median counts as one second).
    """
    schema = (
        "column string, min string, max string, range_s double, median_step_s double, std_step_s double, "
        "is_regular boolean"
    )
    rows = []
    for c in columns_of(df, DATETIME) if columns is None else columns:
        ts = epoch_micros(col(c))
        edge = df.agg(
            F.count(ts).alias("n"),
            iso_text(F.min(col(c))).alias("first"),
            iso_text(F.max(col(c))).alias("last"),
            ((F.max(ts) - F.min(ts)) / F.lit(1e6)).alias("range_s"),
        ).first()
        if edge.n == 0:
            continue
        n_steps = edge.n - 1
        if n_steps == 0:
            rows.append((c, edge.first, edge.last, edge.range_s, None, None, False))
            continue
        mean = edge.range_s / n_steps
        every = steps(df, c, range_rows=range_rows)
        squares, median = _step_summary(every, n_steps, mean, rank_rows)
        std = math.sqrt(squares / (n_steps - 1)) if n_steps > 1 else None
        regular = std is not None and std < abs(median or 1.0) * 0.1
        rows.append((c, edge.first, edge.last, edge.range_s, median, std, regular))
    return df.sparkSession.createDataFrame(rows, schema)
