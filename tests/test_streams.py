"""Streams agree with a batch over the same rows; late rows are dropped."""

import datetime as dt

from pyspark.sql import functions as F

from tabloom.session import scratch_path
from tabloom.streaming.profile import profile_stream, window_profile
from tabloom.streaming.score import start_to_files

SCHEMA = "t timestamp, x double"
START = dt.datetime(2024, 1, 1)


def _write(spark, path, minutes, name):
    rows = [(START + dt.timedelta(minutes=m), None if m % 7 == 0 else float(m)) for m in minutes]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def _run(spark, path, out, progress):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/*")
    found = profile_stream(stream, "t", "30 minutes", "10 minutes", quartiles=False)
    start_to_files(found, out, progress).awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def test_closed_windows_equal_the_batch(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    _write(spark, path, range(0, 200), "a")
    got = _run(spark, path, out, scratch_path(spark, "progress"))
    batch = window_profile(spark.read.schema(SCHEMA).parquet(f"{path}/*"), "t", "30 minutes", quartiles=False)
    closed = batch.filter(F.col("window_end") <= F.lit(START + dt.timedelta(minutes=189)))
    assert got.count() == 6
    assert got.exceptAll(closed).count() == 0


def test_late_rows_are_dropped(spark):
    path, out, progress = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "progress")
    _write(spark, path, range(0, 60), "a")
    first = _run(spark, path, out, progress).count()
    _write(spark, path, [1, 2, 3, *range(60, 130)], "b")
    got = _run(spark, path, out, progress)
    by_start = {r.window_start: r.n_rows for r in got.collect()}
    assert first >= 1 and by_start[START] == 30 and len(by_start) == got.count()
