"""Sources and sinks: S1-S8, S10, S11. Each query writes a table in some format and reads it back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import run
from ..session import scratch_path
from ..sources import readers, sinks
from .base import query, table

_ORDERS_SQL = """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total,
  max(o_custkey) AS last_customer, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day
  FROM orders GROUP BY o_orderstatus"""


def _order_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_custkey").cast("long").alias("last_customer"),
        F.date_format(F.min(F.to_timestamp("o_orderdate")), "yyyy-MM-dd").alias("first_day"),
    )


@query("read_csv", _ORDERS_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".csv"
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return _order_totals(readers.read_table(spark, path))


@query("read_csv_with_schema", _ORDERS_SQL)
def _(spark, sf_dir):
    """A given schema spares the pass that infers one."""
    path = scratch_path(spark, "orders") + ".csv"
    orders = table(spark, sf_dir, "orders")
    orders.write.option("header", True).csv(path)
    return _order_totals(readers.read_csv(spark, path, schema=orders.schema))


@query("read_tsv", _ORDERS_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".tsv"
    table(spark, sf_dir, "orders").write.option("header", True).option("sep", "\t").csv(path)
    return _order_totals(readers.read_table(spark, path))


@query("read_parquet", _ORDERS_SQL)
def _(spark, sf_dir):
    return _order_totals(readers.read_table(spark, f"{sf_dir}/orders.parquet"))


def _as_document(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one task as one JSON array, streamed line by line."""
    opened = False
    for block in blocks:
        rows = block["value"].tolist()
        if rows:
            lines = [("," if opened or i else "[") + r for i, r in enumerate(rows)]
            opened = True
            yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["]" if opened else "[]"]})


# Rows of one JSON document: it is read whole by one task, so a larger table is more documents.
DOCUMENT_ROWS = 100_000


def _write_documents(df: DataFrame, path: str) -> None:
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value")).repartition(max(4, -(-df.count() // DOCUMENT_ROWS)))
    rows.mapInPandas(_as_document, "value string").write.text(path)


@query("read_json", _ORDERS_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".json"
    _write_documents(table(spark, sf_dir, "orders"), path)
    return _order_totals(readers.read_table(spark, path))


@query("read_json_lines", _ORDERS_SQL)
def _(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".jsonl"
    table(spark, sf_dir, "orders").write.json(path)
    return _order_totals(readers.read_table(spark, path))


_JOINED_SQL = """SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@query("read_query", _JOINED_SQL)
def _(spark, sf_dir):
    for name in ("orders", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return readers.from_query(spark, _JOINED_SQL)


@query(
    "read_records",
    """SELECT meaning, weight, count(*) AS n FROM lineitem
    JOIN (VALUES ('A', 'accepted', 1.5::DOUBLE), ('R', 'returned', NULL)) AS v(flag, meaning, weight) ON l_returnflag = flag
    GROUP BY meaning, weight""",
)
def _(spark, sf_dir):
    records = [{"flag": "A", "meaning": "accepted", "weight": 1.5}, {"flag": "R", "meaning": "returned"}]
    flags = readers.from_records(spark, records)
    # Two rows from the caller.
    joined = table(spark, sf_dir, "lineitem").join(F.broadcast(flags), F.col("l_returnflag") == F.col("flag"))
    return joined.groupBy("meaning", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("saved_upload", _ORDERS_SQL)
def _(spark, sf_dir):
    root = scratch_path(spark, "uploads")
    return _order_totals(readers.read_parquet(spark, sinks.save_upload(table(spark, sf_dir, "orders"), root, "d1")))


@query(
    "stored_metadata",
    """SELECT 'd1' AS dataset_id, 'orders' AS name, count(*) AS n_rows, 6 AS n_columns,
    count(DISTINCT o_orderpriority) AS priorities, 'o_orderstatus' AS target FROM orders""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    sinks.store_metadata(run.dataset_summary(table(spark, sf_dir, "orders"), "d1", "orders", "o_orderstatus"), path)
    stored = sinks.load_metadata(spark, path)
    priorities = F.filter("columns_info", lambda c: c["column"] == "o_orderpriority")[0]["n_unique"]
    return stored.select(
        "dataset_id", "name", "n_rows", "n_columns", priorities.alias("priorities"), "target"
    )
