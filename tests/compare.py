"""Run registered queries against their SQL twins: ``python tests/compare.py [-s SF_DIR] [name …]``."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, bool) or value is None:
        return repr(value)
    return f"{type(value).__name__}:{value}"


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None where both sides agree in column names, row count and values."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows; got {got[:3]} want {want[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}" if bad else None


def main() -> None:
    from tabloom.catalog import ORACLES, QUERIES
    from tabloom.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("-s", "--sf-dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(args.sf_dir)
    failed = []
    for name in args.names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, args.sf_dir)
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
                verdict = "ok" if problem is None else f"DIFFERS: {problem}"
            else:
                problem, verdict = None, f"{len(df.collect())} rows, no twin"
        except Exception as exc:
            problem = str(exc)
            verdict = "ERROR: " + "".join(traceback.format_exception_only(exc))[:600]
        if problem is not None:
            failed.append(name)
        print(f"{time.time() - started:7.2f}s  {name}: {verdict}", flush=True)
    print("failed:", failed or "none")


if __name__ == "__main__":
    main()
