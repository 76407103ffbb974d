"""Profile of a stream by event-time window (R2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import as_double, col, numeric_columns
from ..operators.sketches import part_aggregates, part_rows


def window_profile(
    df: DataFrame,
    ts: str,
    window: str = "1 hour",
    columns: Sequence[str] | None = None,
    group: Sequence[str] = (),
    quartiles: bool = True,
) -> DataFrame:
    """Per window and column: rows, missing, mean, sample deviation, extremes and sketched quartiles.

    The same function takes a batch or a stream. State is one row per window and group: the columns are
    aggregates of that row and become rows only afterwards.
    """
    wanted = [c for c in (numeric_columns(df) if columns is None else columns) if c not in group]
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(wanted):
        x = as_double(df, c)
        parts = [
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
        ]
        if quartiles:
            parts.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 1_000).alias("quartiles"))
        aggregates += [p.alias(f"__{i}_{j}") for j, p in enumerate(parts)]
    names = ["count", "mean", "std", "min", "max", *(["quartiles"] if quartiles else [])]
    grouped = df.groupBy(F.window(col(ts), window), *[col(g) for g in group]).agg(*aggregates)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"__{i}_{j}").alias(name) for j, name in enumerate(names)],
        )
        for i, c in enumerate(wanted)
    ]
    long = grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *[col(g) for g in group],
        "n_rows",
        F.explode(F.array(*cells)).alias("cell"),
    )
    return long.select(
        "window_start", "window_end", *[col(g) for g in group], "n_rows", "cell.*",
        (F.col("n_rows") - F.col("cell.count")).alias("n_missing"),
    )


def profile_stream(
    stream: DataFrame,
    ts: str,
    window: str = "1 hour",
    watermark: str = "10 minutes",
    columns: Sequence[str] | None = None,
    group: Sequence[str] = (),
    quartiles: bool = True,
) -> DataFrame:
    """R2: the windowed profile of a stream; rows later than the watermark are dropped, closed windows leave the state."""
    return window_profile(stream.withWatermark(ts, watermark), ts, window, columns, group, quartiles)


def sketch_stream(
    stream: DataFrame,
    ts: str,
    window: str = "1 hour",
    watermark: str = "10 minutes",
    columns: Sequence[str] | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """R2: mergeable parts of a stream, one row per closed window, group and column.

    What a sink has stored merges over any span of windows with ``merge_profiles``, by ``window_start`` truncated to
    days for example. Rows later than the watermark are dropped. The same function takes a batch.
    """
    wanted = [c for c in (numeric_columns(stream) if columns is None else columns) if c not in group and c != ts]
    grouped = (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(col(ts), window), *[col(g) for g in group])
        .agg(*part_aggregates(stream, wanted))
    )
    ends = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return part_rows(grouped, [*ends, *[col(g) for g in group]], wanted)
