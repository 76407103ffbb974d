"""Left join with a one-row-per-key lookup table that stays balanced under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import col

# A table is broadcast up to this many bytes, measured row by row.
BROADCAST_BYTES = 16 << 20
HOT_SHARE = 1_000
_SALTS = 1_024


def _cell_bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c) + 8
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.aggregate(c, F.lit(8).cast("long"), lambda n, x: n + F.coalesce(_cell_bytes(x, inner), F.lit(8)))
        return F.size(c) * 8 + 8
    if kind.typeName() == "vectorudt":
        # Imported here, since Python workers import this module too and pyspark.ml loads much.
        from pyspark.ml.functions import vector_to_array

        return F.size(vector_to_array(c)) * 8 + 8
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """About what the rows take in memory."""
    cells = [F.coalesce(_cell_bytes(col(f.name), f.dataType).cast("long"), F.lit(8)) for f in df.schema.fields]
    return int(df.agg(F.sum(sum(cells, F.lit(16).cast("long"))).alias("n")).first().n or 0)


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    key: str,
    table_bytes: int | None = None,
    n_rows: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add the columns of ``table`` (``key``, values…, ``__n``) to ``df`` by ``key``.

    ``__n`` is how often the key occurs. A table measured as small is broadcast. A larger one is split:
    keys holding more than a thousandth of all rows are fewer than a thousand, so they are broadcast,
    and the rows carrying them are scattered over many salts instead of meeting in one task; only the
    remaining keys are matched by a shuffle.
    """
    size = measured_bytes(table) if table_bytes is None else table_bytes
    values = [c for c in table.columns if c not in (key, "__n")]
    lean = table.select(col(key).alias("__key"), *[col(c) for c in values])
    if size <= broadcast_bytes:
        return df.join(F.broadcast(lean), col(key) == F.col("__key"), "left").drop("__key")

    total = table.agg(F.sum("__n").alias("n")).first().n if n_rows is None else n_rows
    is_hot = F.col("__n") > F.lit(total / HOT_SHARE)
    hot = table.filter(is_hot).select(
        col(key).alias("__hot"), F.struct(*[col(c) for c in values]).alias("__hot_values")
    )
    cold = table.filter(~is_hot).select(
        col(key).alias("__key"), F.lit(0).alias("__salt"), *[col(c).alias(f"__cold_{c}") for c in values]
    )
    marked = df.join(F.broadcast(hot), col(key) == F.col("__hot"), "left")
    # Rows that need no match, or already have one, are spread by the task that read them.
    settled = F.col("__hot").isNotNull() | col(key).isNull()
    spread = F.pmod(F.spark_partition_id(), F.lit(_SALTS)) + 1
    marked = marked.withColumn("__df_salt", F.when(settled, spread).otherwise(0)).withColumn(
        "__df_key", F.when(~settled, col(key))
    )
    joined = marked.join(
        cold, (F.col("__df_key") == F.col("__key")) & (F.col("__df_salt") == F.col("__salt")), "left"
    )
    return joined.select(
        *[col(c) for c in df.columns],
        *[F.coalesce(F.col("__hot_values")[c], F.col(f"__cold_{c}")).alias(c) for c in values],
    )
