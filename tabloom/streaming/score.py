"""Scoring of a stream (R1) and the sink both streams share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import Scorer


def score_stream(scorer: Scorer, stream: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predictions for each arriving row; no state, append mode."""
    if not stream.isStreaming:
        raise ValueError("score a batch with Scorer.score")
    return scorer.score(stream, keep)


def start_to_files(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to Parquet exactly once per row; ``once`` takes what is there and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
