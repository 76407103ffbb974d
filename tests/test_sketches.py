"""Mergeable profiles: parts merge into the profile of all their rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators.sketches import MOMENTS, merge_profiles, read_profile, sketch_profile
from tabloom.streaming.profile import sketch_stream


def sample(spark, n=6000):
    rng = np.random.default_rng(5)
    x = 1e9 + rng.normal(0, 1, n)
    data = pd.DataFrame({
        "part": rng.integers(0, 12, n), "half": rng.integers(0, 2, n), "x": x,
        "few": rng.integers(0, 7, n), "word": [f"w{i}" for i in rng.integers(0, 2500, n)],
    })
    data.loc[::5, "x"] = np.nan
    return spark.createDataFrame(data).withColumn("pair", F.when(F.col("few") > 2, F.struct("few", "half"))), data


def told(profile, *keys):
    return {tuple(r[k] for k in keys) + (r.column,): r for r in read_profile(profile).collect()}


def test_merged_parts_tell_what_the_whole_tells(spark):
    df, data = sample(spark)
    parts = sketch_profile(df, ["part", "half"])
    once = told(merge_profiles(parts, ["half"]), "half")
    twice = told(merge_profiles(merge_profiles(parts, ["half", "part"]), ["half"]), "half")
    assert set(once) == set(twice) == {(h, c) for h in (0, 1) for c in ("x", "few", "word", "pair")}
    for (half, column), row in once.items():
        own = data[data.half == half]
        assert row.n_rows == len(own)
        if column in ("x", "few"):
            values = own[column].dropna()
            assert (row["count"], row.n_missing) == (len(values), len(own) - len(values))
            assert (row.min, row.max) == (values.min(), values.max())
            # The deviation is 1 about a mean of a thousand million: plain sums of squares would lose it.
            assert row.mean == pytest.approx(values.mean(), rel=1e-12) and row.std == pytest.approx(values.std(), rel=1e-6)
            assert row.n_unique == pytest.approx(values.nunique(), rel=0.035)
            for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
                assert (values < row[name]).mean() <= p + 0.02 and (values <= row[name]).mean() >= p - 0.02
        else:
            assert row.mean is row.std is row.q50 is None
        same = twice[half, column]
        assert (row.n_rows, row["count"], row.n_missing, row.min, row.max) == (
            same.n_rows, same["count"], same.n_missing, same.min, same.max
        )
        if row.std is not None:
            assert same.std == pytest.approx(row.std, rel=1e-6)
    words = data[data.half == 0].word.nunique()
    assert once[0, "word"].n_unique == pytest.approx(words, rel=0.035)
    assert once[0, "pair"].n_missing == int((data[data.half == 0].few <= 2).sum())


def test_odd_parts(spark):
    df = spark.createDataFrame(
        [("a", None, None), ("a", float("nan"), None), ("b", 2.0, "t"), (None, 4.0, "t")], "g string, x double, t string"
    )
    parts = sketch_profile(df, ["g"])
    merged = told(merge_profiles(parts))
    assert (merged["x",].n_rows, merged["x",]["count"], merged["x",].n_missing) == (4, 2, 2)
    assert (merged["x",].mean, merged["x",].std, merged["x",].n_unique) == (3.0, pytest.approx(2**0.5), 2)
    assert (merged["t",]["count"], merged["t",].n_unique, merged["t",].q50) == (2, 1, None)
    own = told(merge_profiles(parts, ["g"]), "g")
    assert (own["a", "x"]["count"], own["a", "x"].mean, own["a", "x"].q50, own["a", "x"].n_unique) == (0, None, None, 0)
    assert own["b", "x"].std is None and own[None, "x"].q50 == 4.0
    empty = df.limit(0)
    assert told(merge_profiles(sketch_profile(empty)))["x",].n_rows == 0
    assert merge_profiles(sketch_profile(empty, ["g"]), ["g"]).count() == 0
    with pytest.raises(ValueError, match="count"):
        sketch_profile(df.withColumnRenamed("g", "count"), ["count"])
    with pytest.raises(ValueError, match="no column"):
        sketch_profile(df.select("g"), ["g"])


def test_columns_named_like_those_of_a_profile(spark):
    df = spark.createDataFrame([(1, 2.0, "a b"), (1, 4.0, "c")], "k int, mean double, `n.rows` string")
    found = told(sketch_profile(df, ["k"]), "k")
    assert found[1, "mean"].mean == 3.0 and found[1, "n.rows"].n_unique == 2
    assert list(sketch_profile(df).columns) == ["n_rows", "column", *MOMENTS]


def test_windows_of_a_batch(spark):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("v"))
    parts = sketch_stream(df, "ts", "10 minutes", columns=["v"])
    assert parts.count() == 10
    whole = told(merge_profiles(parts))["v",]
    assert (whole.n_rows, whole.mean, whole.min, whole.max) == (100, 49.5, 0.0, 99.0)
