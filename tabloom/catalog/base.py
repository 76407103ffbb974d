"""The registry and the helpers that Spark queries and SQL twins share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Column kinds of the tables that the SQL twins enumerate.
KINDS = {
    "customer": [
        ("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"),
        ("c_acctbal", "numeric"), ("c_mktsegment", "categorical"),
    ],
    "orders": [
        ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
        ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical"),
    ],
    "lineitem": [
        ("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
        ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
        ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"),
        ("l_linestatus", "categorical"), ("l_shipdate", "datetime"),
    ],
    "events": [
        ("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"),
        ("event_type", "categorical"), ("value", "numeric"), ("props", "categorical"),
    ],
    "part": [
        ("p_partkey", "numeric"), ("p_name", "categorical"), ("p_brand", "categorical"),
        ("p_type", "categorical"), ("p_size", "numeric"), ("p_retailprice", "numeric"),
    ],
}
KINDS["gaps"] = [
    ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"),
    ("l_tax", "numeric"), ("l_linenumber", "numeric"), ("l_returnflag", "categorical"), ("l_shipdate", "datetime"),
]

# The test tables have no missing values; this view of lineitem has some in five columns, and repeated rows.
GAPS_SQL = """
gaps AS (
  SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_quantity * l_quantity * 100 END AS l_extendedprice,
         l_discount,
         nullif(l_tax, 0) AS l_tax,
         l_linenumber,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS l_returnflag,
         CASE WHEN l_partkey % 10 < 7 THEN NULL ELSE l_shipdate END AS l_shipdate
  FROM lineitem
)"""


KINDS["spiked"] = [
    ("row_id", "numeric"), ("l_quantity", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"), ("mark", "categorical"),
]

# Line items with a key, values far from all others in two columns, gaps, and a rare class.
SPIKED_SQL = """
spiked AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id,
         CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 89 = 0 THEN -1000.0 ELSE l_discount END AS l_discount,
         CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_partkey % 50 = 0 THEN 'rare' ELSE 'usual' END AS mark
  FROM lineitem
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twin of GAPS_SQL."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.when(c("l_orderkey") % 7 != 0, c("l_quantity")).alias("l_quantity"),
        F.when(c("l_orderkey") % 2 != 0, c("l_quantity") * c("l_quantity") * 100).alias("l_extendedprice"),
        "l_discount",
        F.nullif(c("l_tax"), F.lit(0.0)).alias("l_tax"),
        "l_linenumber",
        F.when(c("l_linenumber") != 3, c("l_returnflag")).alias("l_returnflag"),
        F.when(c("l_partkey") % 10 >= 7, c("l_shipdate")).alias("l_shipdate"),
    )


def spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twin of SPIKED_SQL."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("row_id"),
        F.when(c("l_orderkey") % 97 == 0, c("l_quantity") * 1000).otherwise(c("l_quantity")).alias("l_quantity"),
        F.when(c("l_orderkey") % 89 == 0, F.lit(-1000.0)).otherwise(c("l_discount")).alias("l_discount"),
        F.when(c("l_partkey") % 4 != 0, c("l_tax")).alias("l_tax"),
        F.when(c("l_partkey") % 50 == 0, "rare").otherwise("usual").alias("mark"),
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, its SQL twin."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round computed numbers, since sums in another order differ in their last digits."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def numeric(name: str) -> list[str]:
    return [c for c, kind in KINDS[name] if kind == "numeric"]


def categorical(name: str) -> list[str]:
    return [c for c, kind in KINDS[name] if kind == "categorical"]


def union_sql(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def stats_sql(name: str) -> str:
    """A ``stats`` CTE: one row per column with its counts."""
    parts = [
        f"SELECT {i} AS position, '{c}' AS name, '{kind}' AS kind, count(*) AS n_rows, "
        f"count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique FROM {name}"
        for i, (c, kind) in enumerate(KINDS[name])
    ]
    return f"stats AS ({union_sql(parts)})"
