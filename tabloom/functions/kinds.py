"""Column kinds decided from the schema alone (P1, P2) and missing-value normalisation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
BOOLEAN = "boolean"
NESTED = "nested"

_DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, _DATETIME_TYPES):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    return NESTED


def kinds(df: DataFrame) -> dict[str, str]:
    """Kind of every column, in column order."""
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind in wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that statistics run on (booleans excluded)."""
    return columns_of(df, NUMERIC)


def plan_numeric_columns(df: DataFrame) -> list[str]:
    """Columns the planning rules call numeric (booleans included)."""
    return columns_of(df, NUMERIC, BOOLEAN)


def select_kind(df: DataFrame, *wanted: str) -> DataFrame:
    """Keep the columns of the given kinds."""
    return df.select(*[col(c) for c in columns_of(df, *wanted)])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns, ignoring names the table does not have."""
    gone = set(names)
    return df.select(*[col(c) for c in df.columns if c not in gone])


def normalize(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in floating columns, so that both count as missing everywhere."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def as_double(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; NaN becomes NULL."""
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c if isinstance(dtype, T.DoubleType) else c.cast("double")
