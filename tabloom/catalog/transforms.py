"""Scalar functions, feature transforms, splits and metrics: F1-F10, P6, T1-T15, V1, V2, V5-V7, V9, V11, X6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import encoders, metrics, profile, split
from ..plans.heuristics import cast_target_text
from .base import GAPS_SQL, gaps, query, rounded, table, union_sql

c = F.col


# --- scalar functions -------------------------------------------------------------------------


@query(
    "text_functions",
    """SELECT p_partkey, lower(trim(p_name)) AS tidy, contains(lower(p_type), 'eco') AS economic,
    regexp_full_match(p_brand, '[A-Za-z0-9+/=_\\-]+') AS hash_like FROM part""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        scalars.tidy_text(c("p_name")).alias("tidy"),
        scalars.mentions(c("p_type"), "ECO").alias("economic"),
        scalars.is_hash_like(c("p_brand")).alias("hash_like"),
    )


_DATE_SQL = """CAST(year(d) AS INT) AS d_year, CAST(month(d) AS INT) AS d_month, CAST(day(d) AS INT) AS d_day,
  CAST(isodow(d) - 1 AS INT) AS d_dow,
  coalesce(CAST(isodow(d) >= 6 AS INT), 0) AS d_is_weekend"""


@query("date_features", f"SELECT o_orderkey, {_DATE_SQL} FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)")
def _(spark, sf_dir):
    renamed = table(spark, sf_dir, "orders").select("o_orderkey", c("o_orderdate").alias("d"))
    return encoders.date_features(renamed, ["d"]).drop("d")


# Every fifth date is broken, in three ways.
_BAD_DATE_SQL = """CASE o_orderkey % 5 WHEN 0 THEN (CASE o_orderkey % 3 WHEN 0 THEN 'soon' WHEN 1 THEN '2024-13-45'
  ELSE NULL END) ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END"""


@query(
    "lenient_dates",
    f"""SELECT o_orderkey, {_DATE_SQL}
    FROM (SELECT o_orderkey, try_cast({_BAD_DATE_SQL} AS TIMESTAMP) AS d FROM orders)""",
)
def _(spark, sf_dir):
    broken = F.when(c("o_orderkey") % 3 == 0, "soon").when(c("o_orderkey") % 3 == 1, "2024-13-45")
    text = F.when(c("o_orderkey") % 5 == 0, broken).otherwise(
        F.date_format(c("o_orderdate"), "yyyy-MM-dd HH:mm:ss")
    )
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", scalars.lenient_timestamp(text).alias("d"))
    return encoders.date_features(parsed, ["d"]).drop("d")


@query(
    "time_functions",
    """SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 6) AS elapsed_s,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events""",
)
def _(spark, sf_dir):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(scalars.elapsed_seconds(start, c("ts")), 6).alias("elapsed_s"),
        scalars.iso_text(c("ts")).alias("iso"),
    )


@query(
    "math_functions",
    """SELECT l_orderkey, l_linenumber, round(sqrt(abs(l_discount - 0.05)), 6) AS root,
    least(greatest(l_quantity - 10, 0.0), 100.0) AS clamped,
    round(l_quantity / nullif(l_tax, 0), 6) AS ratio, nullif(l_tax, 0) AS tax FROM lineitem""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.sqrt(F.abs(c("l_discount") - 0.05)), 6).alias("root"),
        scalars.clamp(c("l_quantity") - 10, 0.0, 100.0).alias("clamped"),
        F.round(scalars.safe_ratio(c("l_quantity"), c("l_tax")), 6).alias("ratio"),
        scalars.zero_to_null(c("l_tax")).alias("tax"),
    )


@query(
    "json_values",
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS document
    FROM customer""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.json_value(c("c_custkey"), c("c_mktsegment")).alias("document")
    )


@query(
    "map_values",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
    count(DISTINCT o_orderpriority) AS entries FROM orders GROUP BY o_orderstatus""",
)
def _(spark, sf_dir):
    # One entry per priority, not per row.
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")
    )
    nested = counts.groupBy("o_orderstatus").agg(
        F.sort_array(F.collect_list(F.struct("o_orderpriority", "n"))).alias("pairs")
    )
    as_map = scalars.text_map(c("pairs.o_orderpriority"), c("pairs.n"))
    return nested.withColumn("m", as_map).select(
        "o_orderstatus", F.col("m")["1-URGENT"].alias("urgent"), F.size("m").cast("long").alias("entries")
    )


# --- imputation and scaling -------------------------------------------------------------------


@query(
    "impute_median",
    f"""WITH {GAPS_SQL}, m AS (SELECT median(l_quantity) AS q, median(l_tax) AS t FROM gaps)
    SELECT l_linenumber, round(sum(coalesce(l_quantity, q)), 4) AS quantity, round(sum(coalesce(l_tax, t)), 4) AS tax,
    count(coalesce(l_tax, t)) AS n FROM gaps, m GROUP BY l_linenumber""",
)
def _(spark, sf_dir):
    df = gaps(spark, sf_dir)
    filled = encoders.impute(df, encoders.median_values(df, ["l_quantity", "l_tax"]))
    return filled.groupBy("l_linenumber").agg(
        F.round(F.sum("l_quantity"), 4).alias("quantity"),
        F.round(F.sum("l_tax"), 4).alias("tax"),
        F.count("l_tax").alias("n"),
    )


@query(
    "impute_mode",
    f"""WITH {GAPS_SQL}, texts AS (SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS line FROM gaps),
    m AS (SELECT (SELECT l_returnflag FROM gaps WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
      ORDER BY count(*) DESC, l_returnflag LIMIT 1) AS f)
    SELECT coalesce(l_returnflag, f) AS l_returnflag, count(*) AS n FROM texts, m GROUP BY 1""",
)
def _(spark, sf_dir):
    df = gaps(spark, sf_dir).select("l_returnflag")
    filled = encoders.impute(df, encoders.mode_values(df, ["l_returnflag"]))
    return filled.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def _scaled(spark, sf_dir, method):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    scaled = encoders.scale(df, encoders.scaler_values(df, ["p_size", "p_retailprice"], method))
    return rounded(scaled, "p_size", "p_retailprice")


def _scale_sql(centre: str, spread: str) -> str:
    parts = ", ".join(
        f"round(({x} - (SELECT {centre.format(x=x)} FROM part)) / (SELECT {spread.format(x=x)} FROM part), 6) AS {x}"
        for x in ("p_size", "p_retailprice")
    )
    return f"SELECT p_partkey, {parts} FROM part"


@query("scale_standard", _scale_sql("avg({x})", "stddev_pop({x})"))
def _(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("scale_minmax", _scale_sql("min({x})", "max({x}) - min({x})"))
def _(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("scale_robust", _scale_sql("median({x})", "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"))
def _(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


# --- encoding ---------------------------------------------------------------------------------

_KEPT_SQL = """kept AS (SELECT p_brand FROM part WHERE p_partkey % 3 > 0 GROUP BY p_brand
  ORDER BY count(*) DESC, p_brand DESC LIMIT 19),
known AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 3 > 0)"""


@query(
    "onehot",
    f"""WITH {_KEPT_SQL} SELECT p_partkey,
    CASE WHEN p_brand IN (SELECT p_brand FROM kept) THEN p_brand
         WHEN p_brand IN (SELECT p_brand FROM known) THEN 'infrequent' END AS hot FROM part""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    train = df.filter(c("p_partkey") % 3 > 0)
    levels, shared = encoders.onehot_levels(train, "p_brand")
    wide = encoders.onehot(df, "p_brand", levels, encoders.category_counts(train, "p_brand") if shared else None)
    # Back to the name of the one column that is set, which shows all of them at once.
    names = [n for n in wide.columns if n.startswith("p_brand_")]
    hot = F.concat_ws(",", *[F.when(c(f"`{n}`") == 1.0, n[len("p_brand_") :]) for n in names])
    return wide.select("p_partkey", F.when(hot != "", hot).alias("hot"))


@query(
    "onehot_few",
    union_sql(
        [
            f"SELECT '{p}' AS priority, CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS DOUBLE) AS n FROM orders"
            for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
        ]
    ),
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority")
    levels, _shared = encoders.onehot_levels(df, "o_orderpriority")
    wide = encoders.onehot(df, "o_orderpriority", levels)
    sums = [F.struct(F.lit(v).alias("priority"), F.sum(f"`o_orderpriority_{v}`").alias("n")) for v in levels]
    return wide.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("one")).select("one.*")


_ORDINAL_SQL = """WITH codes AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code
  FROM (SELECT DISTINCT c_name FROM customer WHERE c_custkey % 4 > 0))
SELECT c_custkey, CAST(coalesce(code, -1) AS DOUBLE) AS c_name_code FROM customer LEFT JOIN codes USING (c_name)"""


@query("ordinal", _ORDINAL_SQL)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    codes = encoders.ordinal_table(df.filter(c("c_custkey") % 4 > 0), "c_name")
    return encoders.ordinal(df, "c_name", codes).drop("c_name")


@query("ordinal_in_ranges", _ORDINAL_SQL)
def _(spark, sf_dir):
    """The same codes from range partitions and a shuffle join, as for very many categories."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    codes = encoders.ordinal_table(df.filter(c("c_custkey") % 4 > 0), "c_name", rank_rows=200)
    return encoders.ordinal(df, "c_name", codes, broadcast_bytes=0).drop("c_name")


@query(
    "target_encoding",
    """WITH train AS (SELECT * FROM part WHERE p_brand <> 'Brand#3'),
    overall AS (SELECT avg(p_retailprice) AS m FROM train),
    means AS (SELECT p_brand, (sum(p_retailprice) + 10 * any_value(m)) / (count(*) + 10) AS e FROM train, overall
      GROUP BY p_brand)
    SELECT p_partkey, round(coalesce(e, m), 6) AS p_brand_mean FROM part LEFT JOIN means USING (p_brand), overall""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    train = df.filter(c("p_brand") != "Brand#3")
    means = encoders.target_mean_table(train, "p_brand", "p_retailprice", smoothing=10.0)
    overall = train.agg(F.avg("p_retailprice").alias("m")).first().m
    coded = encoders.target_encode(df, "p_brand", means, overall)
    return rounded(coded.select("p_partkey", "p_brand_mean"), "p_brand_mean")


@query(
    "label_encoding",
    f"""WITH {GAPS_SQL}, t AS (SELECT coalesce(l_returnflag, '__missing__') AS v FROM gaps)
    SELECT v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS label, count(*) AS n FROM t GROUP BY v""",
)
def _(spark, sf_dir):
    df = gaps(spark, sf_dir).select("l_returnflag")
    coded = encoders.encode_label(df, "l_returnflag", encoders.label_table(df, "l_returnflag"))
    return coded.groupBy(cast_target_text(df, "l_returnflag").alias("value"), "label").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "label_encoding_numbers",
    """SELECT CAST(l_linenumber * 5 AS VARCHAR) AS value,
    CAST(dense_rank() OVER (ORDER BY CAST(l_linenumber * 5 AS VARCHAR)) - 1 AS DOUBLE) AS label, count(*) AS n
    FROM lineitem GROUP BY l_linenumber""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((c("l_linenumber") * 5).alias("y"))
    coded = encoders.encode_label(df, "y", encoders.label_table(df, "y"))
    return coded.groupBy(c("y").cast("string").alias("value"), "label").agg(F.count(F.lit(1)).alias("n"))


# --- derived features -------------------------------------------------------------------------


@query(
    "ratio_features",
    """SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(total, 0), 6) AS l_quantity_div_total
    FROM (SELECT *, l_quantity * (1 - l_tax) - 1 AS total FROM lineitem)""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        (c("l_quantity") * (1 - c("l_tax")) - 1).alias("total"),
    )
    wide = encoders.ratio_features(df, ["l_linenumber", "l_quantity", "l_discount", "l_tax", "total"])
    new = [n for n in wide.columns if "_div_" in n]
    return rounded(wide.select("l_orderkey", "l_linenumber", *new), *new)


@query(
    "product_features",
    """SELECT p_partkey, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice FROM part""",
)
def _(spark, sf_dir):
    wide = encoders.product_features(table(spark, sf_dir, "part"), [("p_size", "p_retailprice")])
    return rounded(wide.select("p_partkey", "p_size_x_p_retailprice"), "p_size_x_p_retailprice", digits=4)


@query(
    "quantile_bins",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
      quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT o_orderkey, CAST(o_totalprice > a AS INT) + CAST(o_totalprice > b AS INT) + CAST(o_totalprice > c AS INT)
    AS o_totalprice_bin FROM orders, q""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return encoders.quantile_bins(df, "o_totalprice", 4).drop("o_totalprice")


# --- splits -----------------------------------------------------------------------------------

# A position both engines can compute; its ties fall on the same side.
# Distinct for all order keys, so that positions have no ties.
_PLACE_SQL = "((o_orderkey * 7919 % 10000019) / 10000019.0)"


def _place():
    return (c("o_orderkey") * 7919 % 10000019) / F.lit(10000019.0)


@query(
    "holdout_split",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus,
      row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_PLACE_SQL}) - 1 AS i,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderkey, o_orderstatus, i < floor(0.2 * n) AS is_valid FROM r""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.holdout(df, 0.2, "o_orderstatus", position=_place())


_TIED_SQL = """WITH r AS (SELECT o_orderstatus, o_orderkey % 3 AS u,
      row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey % 3) - 1 AS i,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)"""


@query(
    "holdout_of_equal_places",
    f"""{_TIED_SQL} SELECT o_orderstatus, u, count(*) AS n, count(*) FILTER (WHERE i < floor(0.2 * n)) AS n_valid
    FROM r GROUP BY o_orderstatus, u""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderstatus", (c("o_orderkey") % 3).alias("u"))
    marked = split.holdout(df, 0.2, "o_orderstatus", position=c("u") / 3)
    return marked.groupBy("o_orderstatus", "u").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"))


@query(
    "holdout_without_key",
    """SELECT o_orderpriority, count(*) AS n, CAST(floor(0.2 * count(*)) AS BIGINT) AS n_valid FROM orders
    GROUP BY o_orderpriority""",
)
def _(spark, sf_dir):
    marked = split.holdout(table(spark, sf_dir, "orders").select("o_orderpriority"), 0.2, "o_orderpriority")
    return marked.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"))


@query(
    "holdout_by_key",
    """SELECT o_orderstatus, count(*) AS n, CAST(floor(0.2 * count(*)) AS BIGINT) AS n_valid FROM orders
    GROUP BY o_orderstatus""",
)
def _(spark, sf_dir):
    marked = split.holdout(table(spark, sf_dir, "orders"), 0.2, "o_orderstatus", key=["o_orderkey"])
    return marked.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid")
    )


_FOLD_SQL = "CAST((i >= floor(0.2 * n)) AS INT) + CAST((i >= floor(0.4 * n)) AS INT) + CAST((i >= floor(0.6 * n)) AS INT) + CAST((i >= floor(0.8 * n)) AS INT)"


@query(
    "cross_folds",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_PLACE_SQL}) - 1 AS i,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderkey, {_FOLD_SQL} AS fold FROM r""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.folds(df, 5, "o_orderstatus", position=_place()).drop("o_orderstatus")


@query(
    "folds_without_key",
    f"""WITH r AS (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority) - 1 AS i,
      count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, {_FOLD_SQL} AS fold, count(*) AS rows FROM r GROUP BY ALL""",
)
def _(spark, sf_dir):
    marked = split.folds(table(spark, sf_dir, "orders").select("o_orderpriority"), 5, "o_orderpriority")
    return marked.groupBy("o_orderpriority", "fold").agg(F.count(F.lit(1)).alias("rows"))


# --- metrics ----------------------------------------------------------------------------------

# A rule that predicts one column from another stands in for a model.
_SCORED_SQL = """scored AS (SELECT CAST(left(o_orderpriority, 1) AS DOUBLE) AS label,
  CAST(o_custkey % 6 AS DOUBLE) AS prediction FROM orders)"""


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.left("o_orderpriority", F.lit(1)).cast("double").alias("label"),
        (c("o_custkey") % 6).cast("double").alias("prediction"),
    )


@query(
    "confusion",
    f"WITH {_SCORED_SQL} SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction",
)
def _(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir))


@query(
    "classification_metrics",
    f"""WITH {_SCORED_SQL}, a AS (SELECT label AS c, count(*) AS actual,
      count(*) FILTER (WHERE label = prediction) AS hit FROM scored GROUP BY label),
    p AS (SELECT prediction AS c, count(*) AS predicted FROM scored GROUP BY prediction)
    SELECT round((SELECT avg(CAST(label = prediction AS INT)) FROM scored), 6) AS accuracy,
    round(sum(actual * 2 * hit / (actual + coalesce(predicted, 0))) / sum(actual), 6) AS f1_weighted
    FROM a LEFT JOIN p USING (c)""",
)
def _(spark, sf_dir):
    return rounded(metrics.classification_metrics(_scored(spark, sf_dir)), "accuracy", "f1_weighted")


@query(
    "regression_metrics",
    """WITH s AS (SELECT l_extendedprice AS y, l_quantity * 2000 + 1000 * l_linenumber AS p FROM lineitem)
    SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
    round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2 FROM s""",
)
def _(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select(
        c("l_extendedprice").alias("label"),
        (c("l_quantity") * 2000 + c("l_linenumber") * 1000).alias("prediction"),
    )
    found = metrics.regression_metrics(scored)
    return rounded(rounded(found, "mae", "rmse", digits=4), "r2")


@query(
    "cluster_count",
    "SELECT count(DISTINCT label) FILTER (WHERE label <> -1) AS n_clusters FROM "
    "(SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings)",
)
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(
        F.when(c("vec_id") % 10 == 0, -1).otherwise(c("label")).alias("prediction")
    )
    return metrics.cluster_count(labels)


@query(
    "without_noise",
    "SELECT label, count(*) AS n FROM (SELECT CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label "
    "FROM embeddings) WHERE label <> -1 GROUP BY label",
)
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(
        F.when(c("vec_id") % 10 == 0, -1).otherwise(c("label")).alias("label")
    )
    return profile.group_sizes(metrics.without_noise(labels, "label"), "label")


@query(
    "silhouette_verdicts",
    """SELECT l_discount, CASE WHEN l_discount * 10 >= 0.5 THEN 'good' WHEN l_discount * 10 >= 0.25 THEN 'moderate'
    ELSE 'weak' END AS verdict, count(*) AS n FROM lineitem GROUP BY l_discount""",
)
def _(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_discount", metrics.silhouette_verdict(c("l_discount") * 10).alias("verdict"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
