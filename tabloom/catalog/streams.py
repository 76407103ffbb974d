"""Streams over the event table: R1, R2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kinds import col
from ..operators.sketches import QUARTILES, merge_profiles, read_profile
from ..plans.heuristics import ProblemType, suggest_plan
from ..plans.registry import candidate
from ..plans.scoring import Scorer
from ..plans.training import Settings, train_supervised
from ..session import scratch_path, written
from ..streaming.profile import profile_stream, sketch_stream, window_profile
from ..streaming.score import score_stream, start_to_files
from .base import query, rounded, table

_WINDOW_SQL = """SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, event_type, count(*) AS n_rows,
  'value' AS "column", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, max(value) AS max, count(*) - count(value) AS n_missing
  FROM (SELECT event_id, ts, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)
  GROUP BY 1, 2"""


def _gappy(df):
    return df.select(
        "ts", "event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value")
    )


def _flat(df):
    out = df.select(
        F.unix_micros("window_start").alias("start_us"), "event_type", "n_rows", "column", "count", "mean", "std",
        "min", "max", "n_missing",
    )
    return rounded(out, "mean", "std")


@query("window_profile", _WINDOW_SQL)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _flat(window_profile(_gappy(events), "ts", "6 hours", ["value"], ["event_type"], quartiles=False))


@query(
    "profile_stream",
    f"""{_WINDOW_SQL}
    HAVING time_bucket(INTERVAL '6 hours', any_value(ts)) + INTERVAL '6 hours'
      <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
)
def _(spark, sf_dir):
    """The windows that the watermark has closed by the end of the stream."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")
    stream = _gappy(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    found = profile_stream(stream, "ts", "6 hours", "10 minutes", ["value"], ["event_type"], quartiles=False)
    out = scratch_path(spark, "windows")
    start_to_files(found, out, scratch_path(spark, "progress")).awaitTermination()
    return _flat(spark.read.schema(found.schema).parquet(out))


_MERGED_SQL = """CAST(count(*) AS BIGINT) AS n_rows, 'value' AS "column", count(value) AS count,
  count(*) - count(value) AS n_missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, max(value) AS max, true AS distinct_near, true AS quartiles_near
  FROM (SELECT event_id, ts, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)"""

# Four standard errors of the distinct count, and three times the error of a quantile's rank.
_DISTINCT_ERROR, _RANK_ERROR = 0.035, 0.02


def _against(rows, merged, keys):
    """The merged profile with a test of its sketches against the rows that it stands for."""
    told = read_profile(merged).filter(F.col("column") == "value")
    x = F.col("value")
    near = F.lit(True)
    for name, p in QUARTILES.items():
        below, upto = F.count_if(x < F.col(name)), F.count_if(x <= F.col(name))
        near = near & F.coalesce(
            (below <= (p + _RANK_ERROR) * F.count(x)) & (upto >= (p - _RANK_ERROR) * F.count(x)), F.lit(False)
        )
    tested = (
        rows.join(told.select(*keys, "n_unique", *QUARTILES), keys)
        .groupBy(*[col(k) for k in keys])
        .agg(
            (F.abs(F.any_value("n_unique") - F.count_distinct(x)) <= _DISTINCT_ERROR * F.count_distinct(x) + 1).alias("distinct_near"),
            near.alias("quartiles_near"),
        )
    )
    out = told.join(tested, keys).select(
        *keys, "n_rows", "column", "count", "n_missing", "mean", "std", "min", "max", "distinct_near", "quartiles_near"
    )
    return rounded(out, "mean", "std")


@query("merged_profile", f"SELECT event_type, {_MERGED_SQL} GROUP BY event_type")
def _(spark, sf_dir):
    """Stored parts of all windows of six hours, merged over time, for each type of event."""
    events = _gappy(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    parts = written(sketch_stream(events, "ts", "6 hours", columns=["value"], group=["event_type"]), "parts")
    return _against(events, merge_profiles(parts, ["event_type"]), ["event_type"])


@query(
    "profile_stream_days",
    f"""SELECT epoch_us(date_trunc('day', time_bucket(INTERVAL '6 hours', ts))) AS day_us, {_MERGED_SQL}
    WHERE time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)
    GROUP BY 1""",
)
def _(spark, sf_dir):
    """The windows that a stream has stored, merged over their days and all types of events."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*")
    stream = _gappy(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    found = sketch_stream(stream, "ts", "6 hours", "10 minutes", ["value"], ["event_type"])
    out = scratch_path(spark, "parts")
    start_to_files(found, out, scratch_path(spark, "progress")).awaitTermination()
    stored = spark.read.schema(found.schema).parquet(out)

    def day(ts):
        return F.unix_micros(F.date_trunc("day", ts)).alias("day_us")

    start = F.window(F.col("ts"), "6 hours")["start"]
    rows = _gappy(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    closed = stored.select("window_start", "event_type").distinct()
    rows = rows.withColumn("window_start", start).join(closed, ["window_start", "event_type"], "left_semi")
    merged = merge_profiles(stored.withColumn("day_us", day(F.col("window_start"))), ["day_us"])
    return _against(rows.withColumn("day_us", day(F.col("window_start"))), merged, ["day_us"])


@query("score_stream")
def _(spark, sf_dir):
    """The stream of line items, scored by a model fitted on the stored ones."""
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice"]
    stored = table(spark, sf_dir, "lineitem").select(*columns)
    target = "l_extendedprice"
    trained = train_supervised(
        stored, target, suggest_plan(stored, target), ProblemType.REGRESSION,
        Settings(trials=1, cv_folds=1), [candidate(ProblemType.REGRESSION, "LinearRegression")],
        key=["l_orderkey", "l_linenumber"],
    )
    schema = table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parque*").select(*columns)
    scored = score_stream(Scorer.of(trained), stream, ("l_orderkey", "l_linenumber"))
    out = scratch_path(spark, "scored")
    start_to_files(scored, out, scratch_path(spark, "progress")).awaitTermination()
    trained.release()
    return spark.read.schema(scored.schema).parquet(out)
