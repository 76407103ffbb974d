"""Profile facets: A1-A16, W1, K1-K3, P2-P5, P9, H8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kinds import CATEGORICAL, NUMERIC, drop_columns, select_kind
from ..functions.scalars import epoch_micros
from ..operators import correlation, profile, tally, temporal
from ..session import written
from .base import GAPS_SQL, KINDS, categorical, gaps, numeric, query, rounded, table, union_sql

_DESCRIBED = ("mean", "std", "min", "q25", "q50", "q75", "max")


def _describe_sql(name: str, cte: str = "") -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 7) AS mean,
        round(stddev_samp({c}), 7) AS std, round(CAST(min({c}) AS DOUBLE), 7) AS min,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 7) AS q25,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 7) AS q50,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 7) AS q75,
        round(CAST(max({c}) AS DOUBLE), 7) AS max FROM {name}"""
        for c in numeric(name)
    ]
    return cte + union_sql(parts)


@query(
    "shape",
    """SELECT count(*) AS n_rows, 6 AS n_columns, 3 AS n_numeric, 2 AS n_categorical, 1 AS n_datetime,
    0 AS n_boolean, 0 AS n_nested FROM events""",
)
def _(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "events"))


@query(
    "shape_nested",
    """SELECT count(*) AS n_rows, 3 AS n_columns, 2 AS n_numeric, 0 AS n_categorical, 0 AS n_datetime,
    0 AS n_boolean, 1 AS n_nested FROM embeddings""",
)
def _(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "embeddings"))


@query("describe_numeric", _describe_sql("lineitem"))
def _(spark, sf_dir):
    return rounded(profile.describe_numeric(table(spark, sf_dir, "lineitem")), *_DESCRIBED, digits=7)


@query("describe_with_gaps", _describe_sql("gaps", f"WITH {GAPS_SQL}\n"))
def _(spark, sf_dir):
    return rounded(profile.describe_numeric(gaps(spark, sf_dir)), *_DESCRIBED, digits=7)


def _missing_sql(name: str) -> str:
    parts = [
        f"""SELECT {i} AS position, '{c}' AS "column", count(*) - count({c}) AS n_missing,
        round((count(*) - count({c})) / greatest(count(*), 1), 4) AS ratio FROM {name}"""
        for i, (c, _) in enumerate(KINDS[name])
    ]
    return f"missing AS (SELECT * FROM ({union_sql(parts)}) WHERE n_missing > 0)"


@query("missing", f"WITH {GAPS_SQL}, {_missing_sql('gaps')} SELECT * FROM missing")
def _(spark, sf_dir):
    return profile.missing(gaps(spark, sf_dir))


@query(
    "missing_totals",
    f"""WITH {GAPS_SQL} SELECT
    CAST(sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c, _ in KINDS['gaps'])}) AS BIGINT) AS total_missing,
    count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c, _ in KINDS['gaps'])}) AS complete_rows
    FROM gaps""",
)
def _(spark, sf_dir):
    return profile.missing_totals(gaps(spark, sf_dir))


@query(
    "complete_rows",
    f"""WITH {GAPS_SQL} SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM gaps
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c, _ in KINDS['gaps'])} GROUP BY l_returnflag""",
)
def _(spark, sf_dir):
    return (
        profile.complete_rows(gaps(spark, sf_dir))
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    )


@query(
    "fill_zero",
    f"""WITH {GAPS_SQL} SELECT l_linenumber, round(sum(coalesce(l_quantity, 0)), 2) AS quantity,
    count(*) FILTER (WHERE coalesce(l_tax, 0) = 0) AS no_tax, count(l_returnflag) AS flagged
    FROM gaps GROUP BY l_linenumber""",
)
def _(spark, sf_dir):
    filled = profile.fill_zero(gaps(spark, sf_dir))
    return filled.groupBy("l_linenumber").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.count_if(F.col("l_tax") == 0).alias("no_tax"),
        F.count("l_returnflag").alias("flagged"),
    )


@query(
    "top_missing",
    f"""WITH {GAPS_SQL}, {_missing_sql('gaps')} SELECT "column", n_missing, ratio FROM missing
    ORDER BY n_missing DESC, position LIMIT 3""",
)
def _(spark, sf_dir):
    return profile.top_missing(gaps(spark, sf_dir), 3)


@query(
    "duplicate_count",
    f"""WITH {GAPS_SQL} SELECT CAST((SELECT count(*) FROM gaps) - (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps))
    AS BIGINT) AS n_duplicates""",
)
def _(spark, sf_dir):
    return profile.duplicate_count(gaps(spark, sf_dir))


@query(
    "duplicate_texts",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS n_duplicates
    FROM documents""",
)
def _(spark, sf_dir):
    return profile.duplicate_count(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query(
    "select_kinds",
    """SELECT count(l_returnflag) AS l_returnflag, count(l_linestatus) AS l_linestatus FROM lineitem""",
)
def _(spark, sf_dir):
    texts = select_kind(table(spark, sf_dir, "lineitem"), CATEGORICAL)
    return texts.agg(*[F.count(c).alias(c) for c in texts.columns])


@query("drop_columns", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type")
def _(spark, sf_dir):
    kept = drop_columns(table(spark, sf_dir, "part"), ["p_name", "p_size", "p_retailprice", "p_partkey", "unknown"])
    return kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("n"))


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _corr_sql(name: str) -> str:
    # Equal text in both halves of a pair would hide a constant column; corr gives NaN there.
    parts = [
        f"""SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS corr,
        count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {name}"""
        for a, b in _pairs(numeric(name))
    ]
    return f"pairs AS ({union_sql(parts)})"


@query("correlations", f"WITH {_corr_sql('lineitem')} SELECT a, b, round(corr, 6) AS corr, n FROM pairs")
def _(spark, sf_dir):
    return rounded(correlation.correlations(table(spark, sf_dir, "lineitem")), "corr")


@query(
    "correlations_with_gaps",
    f"WITH {GAPS_SQL}, {_corr_sql('gaps')} SELECT a, b, round(corr, 6) AS corr, n FROM pairs",
)
def _(spark, sf_dir):
    return rounded(correlation.correlations(gaps(spark, sf_dir)), "corr")


@query(
    "correlations_in_blocks",
    f"WITH {GAPS_SQL}, {_corr_sql('gaps')} SELECT a, b, round(corr, 6) AS corr, n FROM pairs",
)
def _(spark, sf_dir):
    return rounded(correlation.correlations(gaps(spark, sf_dir), wide_above=0), "corr")


@query(
    "correlation_matrix",
    f"""WITH {_corr_sql('orders')}, cells AS (
      SELECT a, b, corr FROM pairs UNION ALL SELECT b, a, corr FROM pairs
      UNION ALL SELECT unnest({numeric('orders')}) AS a, unnest({numeric('orders')}) AS b, 1.0 AS corr
    ) SELECT a, b, round(corr, 6) AS corr FROM cells""",
)
def _(spark, sf_dir):
    return rounded(correlation.correlation_matrix(table(spark, sf_dir, "orders")), "corr")


@query(
    "top_pairs",
    f"""WITH {GAPS_SQL}, {_corr_sql('gaps')} SELECT a, b, round(corr, 6) AS corr, n FROM pairs
    WHERE corr IS NOT NULL ORDER BY abs(pairs.corr) DESC, a, b LIMIT 5""",
)
def _(spark, sf_dir):
    return rounded(correlation.top_pairs(gaps(spark, sf_dir), k=5), "corr")


def _outlier_sql(name: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT {i} AS position, '{c}' AS "column",
        count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
        count(*) AS n_rows, any_value(q1 - 1.5 * (q3 - q1)) AS lower_bound,
        any_value(q3 + 1.5 * (q3 - q1)) AS upper_bound
        FROM {name}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
                             quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {name})"""
        for i, c in enumerate(columns)
    ]
    return f"""outliers AS (SELECT position, "column", n_outliers, round(n_outliers / greatest(n_rows, 1), 4) AS ratio,
    lower_bound, upper_bound FROM ({union_sql(parts)}) WHERE n_outliers > 0)"""


@query(
    "outliers",
    f"""WITH {GAPS_SQL}, {_outlier_sql('gaps', numeric('gaps'))}
    SELECT position, "column", n_outliers, ratio, round(lower_bound, 6) AS lower_bound,
    round(upper_bound, 6) AS upper_bound FROM outliers""",
)
def _(spark, sf_dir):
    return rounded(profile.outliers(gaps(spark, sf_dir)), "lower_bound", "upper_bound")


@query(
    "top_outliers",
    f"""WITH {_outlier_sql('events', ['event_id', 'user_id', 'value'])}
    SELECT "column", n_outliers, ratio, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound
    FROM outliers ORDER BY n_outliers DESC, position LIMIT 3""",
)
def _(spark, sf_dir):
    return rounded(profile.top_outliers(table(spark, sf_dir, "events")), "lower_bound", "upper_bound")


@query(
    "outlier_rows",
    """SELECT event_id, event_type, value FROM events,
    (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def _(spark, sf_dir):
    return profile.outlier_rows(table(spark, sf_dir, "events"), "value").select("event_id", "event_type", "value")


@query(
    "class_balance",
    f"""WITH {GAPS_SQL} SELECT l_returnflag AS value, count(*) AS n,
    round(count(*) / (SELECT count(*) FROM gaps), 4) AS share FROM gaps GROUP BY l_returnflag""",
)
def _(spark, sf_dir):
    return profile.class_balance(gaps(spark, sf_dir), "l_returnflag")


@query(
    "class_balance_summary",
    """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
    SELECT 'toxic' AS target, count(*) AS n_classes, round(max(n) / sum(n), 4) AS imbalance_ratio,
    round(max(n) / min(n), 4) AS majority_minority_ratio, max(n) / min(n) > 5 AND count(*) > 1 AS is_imbalanced
    FROM c""",
)
def _(spark, sf_dir):
    return profile.class_balance_summary(table(spark, sf_dir, "labels"), "toxic")


@query(
    "target_distribution",
    """SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n,
    round(count(*) / (SELECT count(*) FROM customer), 4) AS share
    FROM customer GROUP BY c_nationkey ORDER BY n DESC, value LIMIT 20""",
)
def _(spark, sf_dir):
    return profile.target_distribution(table(spark, sf_dir, "customer"), "c_nationkey")


def _categorical_sql(name: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count(*) OVER () AS n_unique,
        row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, count(*) AS n
        FROM {name} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in columns
    ]
    return f"""SELECT "column", n_unique, CASE WHEN n_unique > 50 THEN 'high' ELSE 'low' END AS cardinality,
    CAST(rank AS INT) AS rank, value, n FROM ({union_sql(parts)}) WHERE rank <= 10"""


@query("categorical_summary", _categorical_sql("events", categorical("events")))
def _(spark, sf_dir):
    return profile.categorical_summary(table(spark, sf_dir, "events"))


@query("categorical_parts", _categorical_sql("part", categorical("part")))
def _(spark, sf_dir):
    return profile.categorical_summary(table(spark, sf_dir, "part"))


@query("categorical_pages", _categorical_sql("pages", ["url"]))
def _(spark, sf_dir):
    return profile.categorical_summary(table(spark, sf_dir, "pages"), ["url"])


@query(
    "n_unique",
    union_sql(
        [f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM lineitem""" for c, _ in KINDS["lineitem"]]
    ),
)
def _(spark, sf_dir):
    return tally.n_unique(table(spark, sf_dir, "lineitem"))


@query("n_unique_sketched")
def _(spark, sf_dir):
    return tally.n_unique(table(spark, sf_dir, "lineitem"), approx=True)


@query(
    "n_unique_sketch_is_near",
    """SELECT column_name AS "column", true AS near FROM (DESCRIBE lineitem)""",
)
def _(spark, sf_dir):
    """Within a fifth of the exact count: four times the deviation that the sketch states."""
    df = table(spark, sf_dir, "lineitem")
    near = tally.n_unique(df, approx=True).withColumnRenamed("n_unique", "about").join(tally.n_unique(df), "column")
    return near.select("column", (F.abs(F.col("about") - F.col("n_unique")) <= F.col("n_unique") / 5).alias("near"))


@query(
    "value_counts",
    f"""WITH {GAPS_SQL}
    SELECT 3 AS position, CAST(NULL AS BIGINT) AS whole, l_tax AS real, CAST(NULL AS VARCHAR) AS text, count(*) AS n
    FROM gaps GROUP BY l_tax
    UNION ALL SELECT 4, l_linenumber, NULL, NULL, count(*) FROM gaps GROUP BY l_linenumber
    UNION ALL SELECT 5, NULL, NULL, l_returnflag, count(*) FROM gaps GROUP BY l_returnflag""",
)
def _(spark, sf_dir):
    return tally.value_counts(gaps(spark, sf_dir), ["l_tax", "l_linenumber", "l_returnflag"])


@query(
    "target_summary",
    """SELECT 'l_extendedprice' AS target, round(avg(l_extendedprice), 6) AS mean,
    round(median(l_extendedprice), 6) AS median, round(stddev_samp(l_extendedprice), 6) AS std FROM lineitem""",
)
def _(spark, sf_dir):
    return rounded(
        profile.target_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "mean", "median", "std"
    )


@query(
    "target_top_values",
    "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, value LIMIT 5",
)
def _(spark, sf_dir):
    return profile.target_top_values(table(spark, sf_dir, "events"), "event_type")


@query(
    "group_means",
    f"SELECT l_returnflag, {', '.join(f'round(avg({c}), 6) AS {c}' for c in numeric('lineitem'))} "
    "FROM lineitem GROUP BY l_returnflag",
)
def _(spark, sf_dir):
    return rounded(profile.group_means(table(spark, sf_dir, "lineitem"), "l_returnflag"), *numeric("lineitem"))


@query("group_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY label")
def _(spark, sf_dir):
    return profile.group_sizes(table(spark, sf_dir, "embeddings"), "label")


def _histogram_sql(name: str) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin,
        lo, (hi - lo) / 20 AS width FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {name}),
        (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {name})
        WHERE x IS NOT NULL"""
        for c in numeric(name)
    ]
    return f"""SELECT "column", bin, round(lo + bin * width, 6) AS lower, round(lo + (bin + 1) * width, 6) AS upper,
    count(*) AS n FROM ({union_sql(parts)}) GROUP BY "column", bin, lo, width"""


@query("histograms", _histogram_sql("lineitem"))
def _(spark, sf_dir):
    return rounded(profile.histograms(table(spark, sf_dir, "lineitem")), "lower", "upper")


_BOXES = ["o_totalprice", "o_custkey"]


@query(
    "boxplots",
    union_sql(
        [
            f"""SELECT '{c}' AS "column", round(CAST(min({c}) AS DOUBLE), 6) AS min,
            round(CAST(min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS DOUBLE), 6)
              AS whisker_low,
            round(any_value(q1), 6) AS q25, round(any_value(q2), 6) AS q50, round(any_value(q3), 6) AS q75,
            round(CAST(max({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS DOUBLE), 6)
              AS whisker_high,
            round(CAST(max({c}) AS DOUBLE), 6) AS max
            FROM orders, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
            quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM orders)"""
            for c in _BOXES
        ]
    ),
)
def _(spark, sf_dir):
    boxes = profile.boxplots(table(spark, sf_dir, "orders"), _BOXES)
    return rounded(boxes, *[c for c in boxes.columns if c != "column"])


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 8")
def _(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "orders"), ["o_orderkey"], 8)


@query(
    "time_steps",
    """WITH d AS (SELECT ts, count(*) - 1 AS n_zero FROM events WHERE ts IS NOT NULL GROUP BY ts)
    SELECT epoch_us(ts) AS ts_us, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6, 6) AS step_s,
    n_zero FROM d""",
)
def _(spark, sf_dir):
    found = temporal.steps(table(spark, sf_dir, "events"), "ts")
    return rounded(found.select(epoch_micros(F.col("ts")).alias("ts_us"), "step_s", "n_zero"), "step_s")


@query(
    "time_steps_in_ranges",
    """WITH d AS (SELECT ts, count(*) - 1 AS n_zero FROM events WHERE ts IS NOT NULL GROUP BY ts)
    SELECT epoch_us(ts) AS ts_us, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6, 6) AS step_s,
    n_zero FROM d""",
)
def _(spark, sf_dir):
    found = temporal.steps(table(spark, sf_dir, "events"), "ts", range_rows=2_000)
    return rounded(found.select(epoch_micros(F.col("ts")).alias("ts_us"), "step_s", "n_zero"), "step_s")


@query(
    "time_steps_per_user",
    """WITH d AS (SELECT user_id, ts, count(*) - 1 AS n_zero FROM events GROUP BY user_id, ts)
    SELECT user_id, epoch_us(ts) AS ts_us,
    round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6, 6) AS step_s, n_zero
    FROM d""",
)
def _(spark, sf_dir):
    found = temporal.steps(table(spark, sf_dir, "events"), "ts", ["user_id"], range_rows=2_000)
    return rounded(found.select("user_id", epoch_micros(F.col("ts")).alias("ts_us"), "step_s", "n_zero"), "step_s")


def _temporal_sql(name: str, column: str) -> str:
    return f"""WITH s AS (SELECT {column} AS ts,
      (epoch_us({column}) - lag(epoch_us({column})) OVER (ORDER BY {column})) / 1e6 AS step
      FROM {name} WHERE {column} IS NOT NULL),
    a AS (SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS lo, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS hi,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS range_s, median(step) AS m, stddev_samp(step) AS s FROM s)
    SELECT '{column}' AS "column", lo AS min, hi AS max, round(range_s, 6) AS range_s, round(m, 6) AS median_step_s,
    round(s, 4) AS std_step_s,
    coalesce(s < abs(CASE WHEN m = 0 THEN 1 ELSE m END) * 0.1, false) AS is_regular FROM a"""


@query("temporal_summary", _temporal_sql("events", "ts"))
def _(spark, sf_dir):
    found = temporal.temporal_summary(table(spark, sf_dir, "events"))
    return rounded(rounded(found, "range_s", "median_step_s"), "std_step_s", digits=4)


@query("temporal_repeats", _temporal_sql("lineitem", "l_shipdate"))
def _(spark, sf_dir):
    found = temporal.temporal_summary(table(spark, sf_dir, "lineitem").select("l_shipdate"))
    return rounded(rounded(found, "range_s", "median_step_s"), "std_step_s", digits=4)


@query(
    "select_numeric",
    f"SELECT {', '.join(f'count({c}) AS {c}' for c in numeric('events'))} FROM events",
)
def _(spark, sf_dir):
    numbers = select_kind(table(spark, sf_dir, "events"), NUMERIC)
    return numbers.agg(*[F.count(c).alias(c) for c in numbers.columns])


_CLOCK_SQL = "(SELECT event_id, TIMESTAMP '2024-03-29 00:00:00' + to_hours(event_id % 96) AS ts FROM events)"


def _clock_changes(spark, sf_dir):
    """Hourly times without a zone over four days, in the night of one of which many zones skip an hour."""
    start = F.expr("TIMESTAMP_NTZ'2024-03-29 00:00:00'")
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") % 96).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", (start + hours).alias("ts"))


@query("temporal_summary_over_a_clock_change", _temporal_sql(_CLOCK_SQL, "ts"))
def _(spark, sf_dir):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        found = temporal.temporal_summary(_clock_changes(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    return rounded(rounded(found, "range_s", "median_step_s"), "std_step_s", digits=4)


@query(
    "time_steps_over_a_clock_change",
    f"""WITH d AS (SELECT ts, count(*) - 1 AS n_zero FROM {_CLOCK_SQL} GROUP BY ts)
    SELECT epoch_us(ts) AS ts_us, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 1e6, 6) AS step_s,
    n_zero FROM d""",
)
def _(spark, sf_dir):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        found = temporal.steps(_clock_changes(spark, sf_dir), "ts")
        found = written(found.select(epoch_micros(F.col("ts")).alias("ts_us"), "step_s", "n_zero"), "steps")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    return rounded(found, "step_s")
