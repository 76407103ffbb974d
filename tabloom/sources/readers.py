"""Tables from files, queries and records."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T


def _delimited(separator: str) -> Callable[[DataFrameReader, str], DataFrame]:
    return lambda reader, path: reader.option("header", True).option("sep", separator).csv(path)


_FORMATS: dict[str, Callable[[DataFrameReader, str], DataFrame]] = {
    "csv": _delimited(","),
    "tsv": _delimited("\t"),
    "parquet": lambda reader, path: reader.parquet(path),
    "json": lambda reader, path: reader.option("multiLine", True).json(path),
    "jsonl": lambda reader, path: reader.json(path),
}


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    sampling_ratio: float | None = None,
) -> DataFrame:
    """A table by its suffix, or by ``fmt``.

    CSV, TSV and JSON are read an extra time to infer their types. Give a ``schema`` for large files, or
    a ``sampling_ratio`` to infer from a part of the rows. One JSON document cannot be split between
    tasks; large JSON data belongs in JSON Lines.
    """
    kind = (fmt or path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2]).lower()
    if kind not in _FORMATS:
        raise ValueError(f"unsupported table format: {kind or path}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif kind in ("csv", "tsv"):
        reader = reader.option("inferSchema", True)
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return _FORMATS[kind](reader, path)


def read_csv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """S1."""
    return read_table(spark, path, "csv", **options)


def read_tsv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """S2."""
    return read_table(spark, path, "tsv", **options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return read_table(spark, path, "parquet")


def read_json(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """One document with an array of records."""
    return read_table(spark, path, "json", **options)


def read_json_lines(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """One record per line."""
    return read_table(spark, path, "jsonl", **options)


def from_query(spark: SparkSession, query: str) -> DataFrame:
    """A query on views of the session."""
    return spark.sql(query)


def from_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A query in a database; with a numeric column and its bounds it is read in parallel.

    Without given bounds the database is asked for the least and the greatest value of the column.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    if bounds is None:
        ends = f"SELECT min({partition_column}) AS low, max({partition_column}) AS high FROM ({query}) AS source"
        bounds = tuple(reader.option("query", ends).load().first())
        reader = spark.read.format("jdbc").option("url", url).options(**options)
    low, high = (0 if b is None else b for b in bounds)
    return (
        reader.option("dbtable", f"({query}) AS source")
        .option("partitionColumn", partition_column)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", partitions)
        .load()
    )


def from_records(
    spark: SparkSession, payload: Mapping[str, Any] | Iterable[Mapping[str, Any]], schema: T.StructType | str | None = None
) -> DataFrame:
    """One record or a list of records held by the caller."""
    rows = [dict(payload)] if isinstance(payload, Mapping) else [dict(r) for r in payload]
    if schema is not None:
        return spark.createDataFrame(rows, schema)
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        raise ValueError("records without fields need a schema")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)
