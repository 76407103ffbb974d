"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# A word: bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

# Ids are broadcast up to this many (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the number as text, modulo ``n``; null where the number is null."""
    return F.crc32(c.cast("string").cast("binary")) % n


def with_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is among ``ids`` (a distinct, written table with that one column)."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def first_of_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``, that with the smallest hash of all columns; rows with a null key all stay.

    Only rows with a repeated key are moved.
    """
    repeated = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    if repeated.isEmpty():
        return df
    ids = written(repeated, "repeated")
    several = with_ids(df, ids, key)
    row = F.struct(*[F.col(c) for c in df.columns])
    one = several.groupBy(key).agg(F.min_by(row, F.struct(F.xxhash64(*df.columns), F.hash(*df.columns))).alias("__row"))
    return with_ids(df, ids, key, "left_anti").unionByName(one.select("__row.*"))
