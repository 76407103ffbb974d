"""Stored datasets, metadata and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

METADATA_SCHEMA = (
    "dataset_id string, name string, n_rows long, n_columns int, size_bytes long, "
    "columns_info array<struct<position:int, column:string, dtype:string, kind:string, n_unique:long, "
    "n_missing:long, example:string>>, target string, problem_type string, created_at string"
)


def save_upload(df: DataFrame, root: str, dataset_id: str) -> str:
    """Keep a table under its id; an id that is taken is an error."""
    path = f"{root.rstrip('/')}/{dataset_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def store_metadata(summary: DataFrame, path: str) -> None:
    """The dataset summary as JSON."""
    summary.write.mode("overwrite").json(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Back with its declared schema; the problem type is text that ``ProblemType`` accepts."""
    return spark.read.schema(METADATA_SCHEMA).json(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """The leaderboard as JSON."""
    board.write.mode("overwrite").json(path)
