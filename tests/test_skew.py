"""Operators that meet a hot key: same result as the plain form, and no group in one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabloom.operators import encoders, lookup, split, tally, temporal


def hot(spark, n=6000):
    """A third of all rows share one key; some have none."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), i % 700))
    return spark.range(n).select("id", key.alias("key"))


def counted(df):
    return df.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("__n"))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_lookup_join(spark, limit):
    df = hot(spark)
    table = counted(df).filter("key <> 'k7'").withColumn("value", F.length("key"))
    got = lookup.lookup_join(df, table, "key", broadcast_bytes=limit)
    want = df.join(table.drop("__n"), "key", "left").select("id", "key", "value")
    assert got.columns == ["id", "key", "value"]
    assert got.exceptAll(want).count() == 0 and got.count() == df.count()


def test_hot_rows_are_spread(spark):
    df = hot(spark).repartition(16)
    table = counted(df).withColumn("value", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = lookup.lookup_join(df, table, "key", broadcast_bytes=0)
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 6000 / 3


def test_ranked_in_ranges(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") * 31 % 3001).alias("k"))
    small = {r.k: r.code for r in encoders.ranked(df, "k").collect()}
    large = {r.k: r.code for r in encoders.ranked(df, "k", rank_rows=100).collect()}
    assert small == large and sorted(large.values()) == list(range(3000))


def test_splits_are_exact_under_skew(spark):
    df = hot(spark).fillna("none")
    plain = split.holdout(df, 0.2, "key", key=["id"])
    sizes = plain.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("v")).collect()
    assert all(r.v == int(0.2 * r.n) for r in sizes)
    again = split.holdout(df.repartition(5), 0.2, "key", key=["id"])
    assert plain.exceptAll(again).count() == 0
    rows = split.folds(df, 5, "key", key=["id"]).groupBy("key", "fold").count().collect()
    hot_sizes = [r["count"] for r in rows if r["key"] == "hot"]
    assert len(hot_sizes) == 5 and max(hot_sizes) - min(hot_sizes) <= 1


def test_split_follows_the_places(spark):
    df = spark.range(4000)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 48)) / F.lit(float(1 << 48))
    rows = split.folds(df.withColumn("p", place), 4, position=F.col("p")).orderBy("p").collect()
    assert [r.fold for r in rows] == [i // 1000 for i in range(4000)]


@pytest.mark.parametrize("key", [None, ["x"]])
def test_split_of_identical_rows(spark, key):
    df = spark.range(2000).select(F.lit("same").alias("x")).repartition(8)
    assert split.holdout(df, 0.25, key=key).filter("is_valid").count() == 500
    assert [r["count"] for r in split.folds(df, 5, key=key).groupBy("fold").count().collect()] == [400] * 5


def test_split_of_few_distinct_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 4).alias("x"), (F.col("id") % 3).alias("y")).coalesce(1)
    for r in split.holdout(df, 0.2, "y").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("v")).collect():
        assert r.v == r.n // 5
    sizes = split.folds(df, 5, "y").groupBy("y", "fold").count().collect()
    assert len(sizes) == 15 and {r["count"] for r in sizes} <= {666, 667}


def test_split_of_many_classes(spark):
    df = spark.range(12_000).select((F.col("id") % 3000).alias("y"), "id")
    marked = split.holdout(df, 0.5, "y", key=["id"])
    assert marked.groupBy("y").agg(F.count_if("is_valid").alias("v")).filter("v <> 2").isEmpty()
    assert split.holdout(df.limit(0), 0.5, "y").count() == 0


def test_steps_with_a_hot_timestamp(spark):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(minutes=(0 if i % 3 == 0 else i)),) for i in range(900)]
    df = spark.createDataFrame(data, "t timestamp")
    plain = temporal.steps(df, "t")
    ranged = temporal.steps(df, "t", range_rows=50)
    assert plain.exceptAll(ranged).count() == 0 and ranged.count() == plain.count()
    a = temporal.temporal_summary(df).first()
    b = temporal.temporal_summary(df, range_rows=50, rank_rows=30).first()
    series = df.toPandas()["t"].sort_values().diff().dt.total_seconds().dropna()
    assert a.median_step_s == b.median_step_s == series.median()
    assert a.std_step_s == pytest.approx(series.std()) and b.std_step_s == pytest.approx(series.std())


def test_steps_per_key_in_ranges(spark):
    start = dt.datetime(2024, 1, 1)
    data = [("a" if i % 3 else "b", start + dt.timedelta(seconds=i * i % 5000)) for i in range(800)]
    df = spark.createDataFrame(data, "k string, t timestamp")
    plain = temporal.steps(df, "t", ["k"])
    ranged = temporal.steps(df, "t", ["k"], range_rows=40)
    assert plain.exceptAll(ranged).count() == 0 and ranged.count() == plain.count()


def test_screened_tally_settles_decisions(spark):
    df = spark.range(4000).select(
        "id", (F.col("id") % 15).alias("fifteen"), (F.col("id") % 700).alias("many"), F.lit(None).cast("int").alias("none")
    )
    exact, screened = tally.collect_tally(df), tally.collect_tally(df, screened=True)
    for name in ("id", "fifteen", "none"):
        assert screened[name].exact and screened[name].n_unique == exact[name].n_unique
    assert not screened["many"].exact
