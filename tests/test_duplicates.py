"""Duplicates by fingerprints against whole rows."""

import re

import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile

ROWS = [
    (None, "a", 1.0), ("a", None, 1.0), ("a", None, 1.0), ("a", "", 1.0), ("", "a", 1.0), ("a", "a", 0.0),
    ("a", "a", -0.0), ("a", "a", float("nan")), ("a", "a", None), (None, None, None), (None, None, None),
    (None, None, None), ("x" * 100_000, "y", 2.0), ("x" * 100_000, "y", 2.0), ("x" * 99_999 + "z", "y", 2.0),
]
EXPECTED = 1 + 1 + 1 + 2 + 1


def count(df, **options):
    return profile.duplicate_count(df, **options).first().n_duplicates


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "s string, t string, x double")


@pytest.mark.parametrize("fingerprint", [None, True, False])
def test_copies_are_counted(spark, fingerprint):
    assert count(frame(spark), fingerprint=fingerprint) == EXPECTED
    assert count(frame(spark, ROWS[2:6]), fingerprint=fingerprint) == 0
    assert count(frame(spark).limit(0), fingerprint=fingerprint) == 0


def test_nested_columns_and_odd_names(spark):
    df = frame(spark).select(
        F.array("s", "t").alias("a.b"), F.struct("s", "x").alias("__print1"), F.create_map(F.lit("k"), "t").alias("n")
    )
    assert count(df) == 5 and count(df) == count(df, fingerprint=False)


def test_equal_fingerprints_of_different_rows_are_no_copies(spark, monkeypatch):
    monkeypatch.setattr(profile, "row_fingerprint", lambda df: [F.lit(7).alias("__print1"), F.lit(7).alias("__print2")])
    assert count(frame(spark)) == EXPECTED


def test_many_shared_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(profile, "BROADCAST_BYTES", 16)
    assert count(frame(spark)) == EXPECTED


def test_unique_rows_move_no_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(profile, "written", lambda df, label: seen.append(df) or df)
    rows = spark.range(50).select(F.repeat(F.col("id").cast("string"), 10_000).alias("text"))
    assert count(rows) == 0
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and not any(re.search(r"\bc0\b", line) for line in moved)
