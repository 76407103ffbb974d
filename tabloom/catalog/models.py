"""Models, training, explanation and reports: M1-M16, V3, V4, V8, K5, K6, W2, X1-X8, T8, T12, T13, O1-O6, S14-S16."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import isolation, metrics, neighbors, outlier_models
from ..operators.blocks import distinct_vectors
from ..operators.boosting import BoostedTrees
from ..operators.dbscan import dbscan
from ..operators.kernel import KernelClassifier, OneClassMachine
from ..operators.perceptron import Net, gradient_sums
from ..operators.shap import mean_abs_shap
from ..operators.ward import ward_merges
from ..plans import explain, run, training
from ..plans.heuristics import ProblemType, suggest_plan
from ..plans.prepare import fit_recipe, varying_features
from ..plans.registry import Context, candidate, candidates
from ..plans.scoring import Scorer
from ..session import scratch_path
from ..sources import sinks
from .base import query, rounded, table

c = F.col
CLASSIFICATION, REGRESSION = ProblemType.CLASSIFICATION, ProblemType.REGRESSION


def _vectors(df, *columns):
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def _tiers(spark, sf_dir):
    """Line items with a class that depends on price and discount."""
    tier = F.when(c("l_extendedprice") > 70000, "high").when(c("l_discount") > 0.05, "deal").otherwise("plain")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", tier.alias("tier")
    )


def _late(spark, sf_dir):
    """Orders with a yes/no target and a date."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate",
        F.when((c("o_totalprice") > 250000) | (c("o_orderpriority") == "1-URGENT"), "yes").otherwise("no").alias("watch"),
    )


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag",
        (c("l_quantity") * (1 - c("l_discount")) * 10).alias("net"), "l_quantity",
    )


def _fit(df, target, kind, specs, key, cv_folds=1, trials=1):
    return training.train_supervised(
        df, target, suggest_plan(df, target), kind, training.Settings(trials=trials, cv_folds=cv_folds), specs, key
    )


def _board(spark, trained):
    board = training.leaderboard(spark, trained).select("rank", "name", "score", "metrics", "params", "error")
    trained.release()
    return board


# --- supervised models ------------------------------------------------------------------------

_LINE_KEY = ["l_orderkey", "l_linenumber"]

for _name, _specs in {
    "logistic_regression": [("LogisticRegression", {})],
    "random_forest_classifier": [("RandomForest", {"numTrees": 20, "maxDepth": 6})],
    "support_vectors": [("SVM", {"kernel": "linear"})],
}.items():

    @query(_name)
    def _(spark, sf_dir, specs=_specs):
        chosen = [candidate(CLASSIFICATION, n, **p) for n, p in specs]
        return _board(spark, _fit(_tiers(spark, sf_dir), "tier", CLASSIFICATION, chosen, _LINE_KEY))


@query("boosted_trees_classifier")
def _(spark, sf_dir):
    spec = candidate(CLASSIFICATION, "BoostedTrees", maxIter=10, maxDepth=3)
    return _board(spark, _fit(_late(spark, sf_dir), "watch", CLASSIFICATION, [spec], ["o_orderkey"]))


@query("boosted_three_classes")
def _(spark, sf_dir):
    chosen = [candidate(CLASSIFICATION, "BoostedTrees", maxIter=10, maxDepth=3), candidate(CLASSIFICATION, "BoostedLeaves", maxIter=10, maxLeaves=8)]
    return _board(spark, _fit(_tiers(spark, sf_dir), "tier", CLASSIFICATION, chosen, _LINE_KEY))


_THIRDS_SQL = """SELECT l_quantity, l_discount, l_tax,
    CASE WHEN l_discount > 0.05 THEN 0 WHEN l_quantity > 30 THEN 1 ELSE 2 END AS label FROM lineitem"""


def _thirds(spark, sf_dir):
    """Line items with three classes, by columns of few values."""
    label = F.when(c("l_discount") > 0.05, 0.0).when(c("l_quantity") > 30, 1.0).otherwise(2.0)
    columns = ("l_quantity", "l_discount", "l_tax")
    return _vectors(table(spark, sf_dir, "lineitem").select(*[c(x).cast("double").alias(x) for x in columns], label.alias("label")), *columns)


@query(
    "boosted_first_split",
    f"""WITH r AS ({_THIRDS_SQL}),
    k AS (SELECT label AS k, count(*) / (SELECT count(*) FROM r)::DOUBLE AS p FROM r GROUP BY label),
    x AS (SELECT 0 AS feature, l_quantity::DOUBLE AS x, label FROM r UNION ALL SELECT 1, l_discount, label FROM r
          UNION ALL SELECT 2, l_tax, label FROM r),
    v AS (SELECT k, p, feature, x, sum(p - (label = k)::INT) AS g, count(*) * p * (1 - p) AS h, count(*) AS n FROM x, k GROUP BY k, p, feature, x),
    b AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER a AS gt, sum(h) OVER a AS ht FROM v
          WINDOW w AS (PARTITION BY k, feature ORDER BY x), a AS (PARTITION BY k, feature)),
    s AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM b
          WHERE hl >= 1 AND ht - hl >= 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(gain, 6) DESC, feature, x) AS nth FROM s)
    SELECT k::INT AS class, feature::INT AS feature, x AS threshold, nl::BIGINT AS n_left, round(gain, 4) AS gain FROM o WHERE nth = 1""",
)
def _(spark, sf_dir):
    model = BoostedTrees(1, 0.1, 1, n_classes=3).fit(_thirds(spark, sf_dir))
    rows = [
        (k, int(t.feature[0]), float(t.threshold[0]), int(t.cover[t.left[0]]), round(float(t.gain[0]), 4)) for k, t in enumerate(model.rounds[0])
    ]
    return spark.createDataFrame(rows, "class int, feature int, threshold double, n_left bigint, gain double")


@query(
    "boosted_stump_shap",
    """WITH m AS (SELECT *, avg(l_extendedprice) OVER (PARTITION BY l_quantity > 25) AS side, avg(l_extendedprice) OVER () AS mean FROM (
      SELECT l_quantity, CASE WHEN l_quantity > 25 THEN 900.0 ELSE 100.0 END + l_tax * 100 AS l_extendedprice FROM lineitem))
    SELECT 'l_quantity' AS feature, round(avg(abs(side - mean)), 4) AS importance FROM m
    UNION ALL SELECT 'l_discount', 0.0""",
)
def _(spark, sf_dir):
    price = F.when(c("l_quantity") > 25, 900.0).otherwise(100.0) + c("l_tax") * 100
    df = _vectors(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", price.alias("label")), "l_quantity", "l_discount")
    model = BoostedTrees(1, 1.0, 1, l2=0.0).fit(df)
    return mean_abs_shap(df, model, ["l_quantity", "l_discount"]).withColumn("importance", F.round("importance", 4))


@query("perceptron")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn(
        "rich", F.when(c("c_acctbal") > 5000, "yes").otherwise("no")
    ).select("c_nationkey", "c_acctbal", "c_mktsegment", "rich")
    plan = suggest_plan(df, "rich")
    plan.drop.pop("c_acctbal", None)
    plan.imputation["c_acctbal"], plan.encoders["c_acctbal"] = "none", "passthrough"
    trained = training.train_supervised(
        df, "rich", plan, CLASSIFICATION, training.Settings(trials=1, cv_folds=1),
        [candidate(CLASSIFICATION, "MLP", hidden=(8,))],
    )
    return _board(spark, trained)


@query(
    "perceptron_gradient",
    """WITH t AS (SELECT l_quantity / 50 AS quantity, l_discount * 10 AS discount,
      CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem)
    SELECT k AS class, round(avg((1.0 / 3 - CAST(y = k AS INT)) * quantity), 6) AS d_quantity,
    round(avg((1.0 / 3 - CAST(y = k AS INT)) * discount), 6) AS d_discount, round(avg(1.0 / 3 - CAST(y = k AS INT)), 6) AS d_shift
    FROM t, (VALUES (0), (1), (2)) AS classes(k) GROUP BY k""",
)
def _(spark, sf_dir):
    """The first gradient of a net without hidden layers, from weights of zero."""
    y = F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").select(F.array(c("l_quantity") / 50, c("l_discount") * 10).alias("x"), y.alias("y"))
    net = Net((2, 3), np.zeros(2 * 3 + 3))
    _, n, total = gradient_sums(rows, net, rows.rdd.getNumPartitions())
    weights, shifts = net.pairs(total / n)[0]
    found = [(k, float(weights[0, k]), float(weights[1, k]), float(shifts[k])) for k in range(3)]
    out = spark.createDataFrame(found, "class int, d_quantity double, d_discount double, d_shift double")
    return rounded(out, "d_quantity", "d_discount", "d_shift")


for _name, _spec_of in {
    "linear_regression": ("LinearRegression", {}),
    "random_forest_regressor": ("RandomForest", {"numTrees": 20, "maxDepth": 6}),
    "boosted_trees_regressor": ("BoostedTrees", {"maxIter": 10, "maxDepth": 4}),
    "gradient_boosting": ("GradientBoosting", {}),
}.items():

    @query(_name)
    def _(spark, sf_dir, spec=_spec_of):
        chosen = [candidate(REGRESSION, spec[0], **spec[1])]
        return _board(spark, _fit(_prices(spark, sf_dir), "net", REGRESSION, chosen, _LINE_KEY))


@query(
    "regression_line",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem""",
)
def _(spark, sf_dir):
    df = _vectors(table(spark, sf_dir, "lineitem").withColumnRenamed("l_extendedprice", "label"), "l_quantity")
    model = candidate(REGRESSION, "LinearRegression").build({}, Context(df.count(), 1)).fit(df)
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 4), round(model.intercept, 2))], "slope double, intercept double"
    )


@query(
    "nearest_neighbors",
    """WITH pairs AS (SELECT q.vec_id, q.label AS actual, p.label,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY
        list_distance(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), p.vec_id) AS i
      FROM embeddings q, embeddings p WHERE q.vec_id % 5 = 0 AND p.vec_id % 5 > 0),
    votes AS (SELECT vec_id, label, count(*) AS n FROM pairs WHERE i <= 5 GROUP BY vec_id, label)
    SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM votes
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", c("embedding").alias("features"), "label")
    model = neighbors.NearestNeighbors(5).fit(df.filter(c("vec_id") % 5 > 0))
    return model.transform(df.filter(c("vec_id") % 5 == 0)).select("vec_id", "prediction")


@query(
    "nearest_neighbors_weighted",
    """WITH points AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y, c_mktsegment AS s
      FROM customer),
    pairs AS (SELECT q.id, p.s, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d,
      row_number() OVER (PARTITION BY q.id ORDER BY sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2), p.id) AS i
      FROM points q, points p WHERE q.id % 10 = 0 AND p.id % 10 > 0),
    votes AS (SELECT id, s, round(sum(1 / d), 9) AS v FROM pairs WHERE i <= 7 GROUP BY id, s)
    SELECT id, s AS predicted FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, s) = 1""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("id"), (c("c_acctbal") / 1000).alias("x"), c("c_nationkey").cast("double").alias("y"),
        F.array_position(_segments(), c("c_mktsegment")).cast("double").alias("label"),
    )
    df = df.select("id", F.array("x", "y").alias("features"), "label")
    model = neighbors.NearestNeighbors(7, "distance", block=200).fit(df.filter(c("id") % 10 > 0))
    found = model.transform(df.filter(c("id") % 10 == 0))
    return found.select("id", F.element_at(_segments(), c("prediction").cast("int")).alias("predicted"))


def _segments():
    return F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])


# --- clustering and anomalies -----------------------------------------------------------------


def _part_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", (c("p_size") / 10).alias("x"), ((c("p_retailprice") - 900) / 20).alias("y")
    )
    return _vectors(df, "x", "y")


@query("kmeans")
def _(spark, sf_dir):
    spec = candidate(ProblemType.CLUSTERING, "KMeans")
    df = _part_vectors(spark, sf_dir).persist()
    scored = spec.build(spec.params, Context(df.count(), 2)).fit(df).transform(df)
    return scored.select("p_partkey", "prediction")


@query("bisecting_kmeans")
def _(spark, sf_dir):
    df = _part_vectors(spark, sf_dir).persist()
    return BisectingKMeans(k=4, seed=42).fit(df).transform(df).select("p_partkey", "prediction")


# The customers of a market segment lie apart from all others by far more than among themselves.
_PLACE = "list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) * 1000"


@query(
    "agglomerative",
    f"""WITH p AS (SELECT {_PLACE} AS x, c_nationkey AS y FROM customer),
    s AS (SELECT x, count(*) AS n, round(avg(y), 6) AS mean FROM p GROUP BY x)
    SELECT (row_number() OVER (ORDER BY n DESC, x) - 1)::INT AS prediction, n, mean FROM s""",
)
def _(spark, sf_dir):
    place = F.array_position(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), c("c_mktsegment"))
    df = _vectors(table(spark, sf_dir, "customer").select((place * 1000).alias("x"), c("c_nationkey").alias("y")), "x", "y")
    spec = candidate(ProblemType.CLUSTERING, "Agglomerative", k=5)
    scored = spec.build(spec.params, Context(df.count(), 2)).fit(df).transform(df)
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean"))


@query(
    "ward_costs",
    """WITH RECURSIVE p AS (SELECT n_nationkey AS id, sqrt(n_nationkey + 1) * 10 AS x, n_nationkey * 7 % 25 * 1.37 AS y FROM nation),
    t AS (SELECT 0 AS step, list({'id': id, 'n': 1::DOUBLE, 'x': x::DOUBLE, 'y': y::DOUBLE} ORDER BY id) AS g, NULL::DOUBLE AS cost FROM p
      UNION ALL
      SELECT step + 1, list_append(list_filter(g, lambda c: c.id <> m.a.id AND c.id <> m.b.id),
        {'id': m.a.id, 'n': m.a.n + m.b.n, 'x': (m.a.x * m.a.n + m.b.x * m.b.n) / (m.a.n + m.b.n), 'y': (m.a.y * m.a.n + m.b.y * m.b.n) / (m.a.n + m.b.n)}), m.cost
      FROM (SELECT step, g, list_reduce(flatten(list_transform(g, lambda a: list_transform(list_filter(g, lambda b: b.id > a.id),
          lambda b: {'cost': a.n * b.n / (a.n + b.n) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'a': a, 'b': b}))),
          lambda u, v: CASE WHEN v.cost < u.cost THEN v ELSE u END) AS m FROM t WHERE len(g) > 1))
    SELECT round(cost, 6) AS cost FROM t WHERE step > 0""",
)
def _(spark, sf_dir):
    df = _vectors(table(spark, sf_dir, "nation").select((F.sqrt(c("n_nationkey") + 1) * 10).alias("x"), (c("n_nationkey") * 7 % 25 * 1.37).alias("y")), "x", "y")
    return ward_merges(distinct_vectors(df), finish=4).select(F.round("cost", 6).alias("cost"))


@query("silhouette")
def _(spark, sf_dir):
    df = _part_vectors(spark, sf_dir)
    scored = KMeans(k=3, seed=42).fit(df).transform(df)
    return spark.createDataFrame([(metrics.silhouette(scored),)], "silhouette_sq double").withColumn(
        "verdict", metrics.silhouette_verdict(c("silhouette_sq"))
    )


@query(
    "silhouette_of_labels",
    """WITH d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other, a.vec_id = b.vec_id AS same,
      list_sum(list_transform(range(1, len(a.embedding) + 1),
        lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]) * (a.embedding[i]::DOUBLE - b.embedding[i]))) AS d
      FROM embeddings a, embeddings b),
    m AS (SELECT id, own, other, CASE WHEN own = other THEN sum(d) / greatest(count(*) - 1, 1) ELSE avg(d) END AS d,
      count(*) AS n FROM d GROUP BY id, own, other),
    s AS (SELECT id, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b,
      max(n) FILTER (WHERE own = other) AS n FROM m GROUP BY id)
    SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_sq FROM s""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(
        array_to_vector(c("embedding").cast("array<double>")).alias("features"), c("label").alias("prediction")
    )
    value = metrics.silhouette(df)
    return rounded(spark.createDataFrame([(value,)], "silhouette_sq double"), "silhouette_sq")


@query(
    "fitted_line",
    """WITH s AS (SELECT covar_samp(l_extendedprice, l_quantity) AS y1, covar_samp(l_extendedprice, l_discount) AS y2,
      var_samp(l_quantity) AS s11, var_samp(l_discount) AS s22, covar_samp(l_quantity, l_discount) AS s12,
      avg(l_extendedprice) AS y, avg(l_quantity) AS x1, avg(l_discount) AS x2 FROM lineitem),
    b AS (SELECT *, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS b1, (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS b2
      FROM s)
    SELECT round(b1, 2) AS quantity, round(b2, 0) AS discount, round(y - b1 * x1 - b2 * x2, 1) AS intercept FROM b""",
)
def _(spark, sf_dir):
    df = _vectors(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").withColumnRenamed("l_extendedprice", "label")
    model = candidate(REGRESSION, "LinearRegression").build({}, Context(df.count(), 2)).fit(df)
    row = (*(float(x) for x in model.coefficients), float(model.intercept))
    found = spark.createDataFrame([row], "quantity double, discount double, intercept double")
    return found.select(F.round("quantity", 2).alias("quantity"), F.round("discount", 0).alias("discount"), F.round("intercept", 1).alias("intercept"))


@query(
    "density_clusters",
    """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey * 0.1 AS y FROM customer),
    near AS (SELECT a.id AS a, b.id AS b FROM p a, p b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.12),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
    link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    walk(id, root) AS (SELECT id, id FROM core
      UNION SELECT link.b, walk.root FROM walk JOIN link ON walk.id = link.a),
    root AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
    first AS (SELECT root, min(x) AS fx, min_by(y, (x, y)) AS fy FROM root JOIN p USING (id) GROUP BY root),
    numbered AS (SELECT root, row_number() OVER (ORDER BY fx, fy) - 1 AS label FROM first),
    cored AS (SELECT id, label FROM root JOIN numbered USING (root)),
    border AS (SELECT near.a AS id, min(label) AS label FROM near JOIN cored ON near.b = cored.id
      WHERE near.a NOT IN (SELECT id FROM core) GROUP BY near.a)
    SELECT p.id, CAST(coalesce(cored.label, border.label, -1) AS INT) AS prediction
    FROM p LEFT JOIN cored USING (id) LEFT JOIN border USING (id)""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("id"),
        F.array(c("c_acctbal") / 1000, c("c_nationkey") * F.lit(0.1)).alias("features"),
    )
    return dbscan(df, 0.12, 5, block=300).select("id", "prediction")


@query(
    "local_outlier_factor",
    """WITH p AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey * 0.1 AS y FROM customer),
    near AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a, p b WHERE a.id <> b.id
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) <= 20),
    reach AS (SELECT a AS id, max(d) AS r FROM near GROUP BY a),
    density AS (SELECT a AS id, 1 / (avg(greatest(d, r)) + 1e-10) AS l FROM near JOIN reach ON b = reach.id GROUP BY a)
    SELECT near.a AS id, round(avg(n.l) / any_value(m.l), 6) AS score FROM near JOIN density n ON near.b = n.id
    JOIN density m ON near.a = m.id GROUP BY near.a""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("id"),
        F.array(c("c_acctbal") / 1000, c("c_nationkey") * F.lit(0.1)).alias("features"),
    )
    return rounded(neighbors.local_outlier_factor(df, 20, block=300).select("id", "score"), "score")


def _rings(spark, sf_dir):
    """Customers on two rings around one centre; the segment tells which."""
    angle, outer = c("c_custkey") * 2.399963, c("c_mktsegment").isin("BUILDING", "MACHINERY")
    radius = F.when(outer, 3.0).otherwise(1.0) + (c("c_custkey") * 31 % 101 - 50) / 500
    df = table(spark, sf_dir, "customer").select((radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), outer.cast("double").alias("label"))
    return _vectors(df, "x", "y")


@query("kernel_machine", "SELECT 'rbf' AS kernel, count(*) AS n, true AS parted FROM customer UNION ALL SELECT 'linear', count(*), false FROM customer")
def _(spark, sf_dir):
    """The Gaussian kernel parts rings that a line cannot: more than 95 % are right."""
    df, rows = _rings(spark, sf_dir), []
    for kernel in ("rbf", "linear"):
        scored = KernelClassifier(kernel, 0.001, size=200).fit(df).transform(df)
        n, share = scored.agg(F.count(F.lit(1)), F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()
        rows.append((kernel, n, share > 0.95))
    return spark.createDataFrame(rows, "kernel string, n bigint, parted boolean")


@query("one_class_machine", "SELECT count(*) AS n, true AS near_nu, true AS centre_flagged FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark, sf_dir):
    """The flagged share is within 0.01 of nu, and the empty centre of a ring is flagged."""
    df = _rings(spark, sf_dir).filter("label = 1")
    model = OneClassMachine(0.05, gamma=1.0, size=200, steps=5).fit(df)
    centre = _vectors(spark.range(1).select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), "x", "y")
    told = model.transform(df).agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg((F.col("prediction") == -1).cast("double")) - 0.05) <= 0.01).alias("near_nu"))
    return told.crossJoin(model.transform(centre).select((F.col("prediction") == -1).alias("centre_flagged")))


@query("isolation_forest")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    forest = isolation.fit_isolation_forest(df, ["user_id", "value"])
    scored = df.withColumn("score", forest.score(df))
    return isolation.flag_anomalies(scored, "score", 0.05).select("event_id", "score", "is_anomaly")


@query("anomaly_summary")
def _(spark, sf_dir):
    return isolation.anomaly_summary(table(spark, sf_dir, "events"), ["user_id", "value"])


@query(
    "mahalanobis",
    """WITH s AS (SELECT avg(l_quantity) AS ma, stddev_samp(l_quantity) AS sa, avg(l_extendedprice) AS mb,
      stddev_samp(l_extendedprice) AS sb, corr(l_quantity, l_extendedprice) AS r FROM lineitem),
    z AS (SELECT l_orderkey, l_linenumber, (l_quantity - ma) / sa AS a, (l_extendedprice - mb) / sb AS b, r
      FROM lineitem, s)
    SELECT l_linenumber, count(*) AS n, round(avg(sqrt((a * a - 2 * r * a * b + b * b) / (1 - r * r))), 6) AS mean_score,
    round(max(sqrt((a * a - 2 * r * a * b + b * b) / (1 - r * r))), 6) AS max_score FROM z GROUP BY l_linenumber""",
)
def _(spark, sf_dir):
    df = _vectors(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    scored = outlier_models.MahalanobisEstimator(0.05).fit(df).transform(df)
    return scored.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.max("score"), 6).alias("max_score"),
    )


@query(
    "z_scores",
    """SELECT event_id, round(abs(value - m) / s, 6) AS score FROM events,
    (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""",
)
def _(spark, sf_dir):
    return rounded(
        outlier_models.z_scores(table(spark, sf_dir, "events").select("event_id", "value"), "value").drop("value"),
        "score",
    )


# --- preparation and training -----------------------------------------------------------------


@query(
    "prepared_features",
    """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) /
      (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS price,
    CAST(o_orderpriority = '2-HIGH' AS DOUBLE) AS high,
    round((month(o_orderdate) - (SELECT avg(month(o_orderdate)) FROM orders)) /
      (SELECT stddev_pop(month(o_orderdate)) FROM orders), 6) AS month FROM orders""",
)
def _(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    plan = suggest_plan(df)
    plan.drop.pop("o_totalprice", None)
    recipe = fit_recipe(df, replace(plan, scaling="standard"))
    at = {n: i for i, n in enumerate(recipe.feature_names)}
    x = vector_to_array("features")
    return recipe.apply(df, keep=("o_orderkey",)).select(
        "o_orderkey",
        F.round(x[at["o_totalprice"]], 6).alias("price"),
        x[at["o_orderpriority_2-HIGH"]].alias("high"),
        F.round(x[at["o_orderdate_month"]], 6).alias("month"),
    )


@query(
    "varying_features",
    """WITH f AS (SELECT l_quantity, 1.0 AS one, l_tax, 0.0 AS none FROM lineitem)
    SELECT feature FROM (
      SELECT 'l_quantity' AS feature, var_pop(l_quantity) AS v FROM f UNION ALL SELECT 'one', var_pop(one) FROM f
      UNION ALL SELECT 'l_tax', var_pop(l_tax) FROM f UNION ALL SELECT 'none', var_pop(none) FROM f) WHERE v > 0""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", F.lit(1.0).alias("one"), "l_tax", F.lit(0.0).alias("none"))
    kept = varying_features(_vectors(df, *df.columns))
    return spark.createDataFrame([(df.columns[i],) for i in kept], "feature string")


@query("model_search")
def _(spark, sf_dir):
    logistic = next(s for s in candidates(CLASSIFICATION) if s.name == "LogisticRegression")
    return _board(spark, _fit(_late(spark, sf_dir), "watch", CLASSIFICATION, [logistic], ["o_orderkey"], 3, 3))


_BOARD_SQL = """WITH board AS (SELECT o_orderpriority AS name, avg(o_totalprice) AS a, stddev_samp(o_totalprice) AS b
  FROM orders GROUP BY 1)"""


def _price_board(spark, sf_dir):
    """Two numbers per priority in the shape of a leaderboard."""
    stats = table(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("name")).agg(
        F.avg("o_totalprice").alias("a"), F.stddev_samp("o_totalprice").alias("b")
    )
    return training.rank_scores(stats, "a").withColumn("time_s", F.lit(0.0)).withColumn(
        "metrics", F.create_map(F.lit("mean"), c("a"), F.lit("deviation"), c("b"))
    )


@query(
    "leaderboard_rank",
    f"{_BOARD_SQL} SELECT CAST(row_number() OVER (ORDER BY a DESC NULLS LAST, name) AS INT) AS rank, name FROM board",
)
def _(spark, sf_dir):
    return _price_board(spark, sf_dir).select("rank", "name")


@query(
    "leaderboard_table",
    f"""{_BOARD_SQL} SELECT CAST(row_number() OVER (ORDER BY a DESC NULLS LAST, name) AS INT) AS rank, name,
    0.0::DOUBLE AS time_s, round(a, 4) AS mean, round(b, 4) AS deviation FROM board""",
)
def _(spark, sf_dir):
    return rounded(training.leaderboard_table(_price_board(spark, sf_dir)), "mean", "deviation", digits=4)


# --- explanation ------------------------------------------------------------------------------


@query(
    "linear_importance",
    """SELECT 'l_quantity' AS feature, round(avg(abs(2.5 * (l_quantity - m))), 6) AS importance
      FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)
    UNION ALL SELECT 'l_discount', round(avg(abs(-40.0 * (l_discount - m))), 6)
      FROM lineitem, (SELECT avg(l_discount) AS m FROM lineitem)""",
)
def _(spark, sf_dir):
    found = explain.linear_importance(table(spark, sf_dir, "lineitem"), {"l_quantity": 2.5, "l_discount": -40.0})
    return rounded(found, "importance")


@query(
    "top_features",
    """WITH f AS (SELECT 'l_quantity' AS feature, avg(abs(2.5 * (l_quantity - m))) AS importance
      FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)
    UNION ALL SELECT 'l_discount', avg(abs(-40.0 * (l_discount - m)))
      FROM lineitem, (SELECT avg(l_discount) AS m FROM lineitem)
    UNION ALL SELECT 'l_tax', avg(abs(4000.0 * (l_tax - m))) FROM lineitem, (SELECT avg(l_tax) AS m FROM lineitem))
    SELECT feature, round(importance, 6) AS importance,
    CAST(row_number() OVER (ORDER BY f.importance DESC, feature) AS INT) AS rank FROM f
    ORDER BY f.importance DESC, feature LIMIT 2""",
)
def _(spark, sf_dir):
    found = explain.linear_importance(
        table(spark, sf_dir, "lineitem"), {"l_quantity": 2.5, "l_discount": -40.0, "l_tax": 4000.0}
    )
    return rounded(explain.top_features(found, 2), "importance")


@query("permutation_importance")
def _(spark, sf_dir):
    spec = candidate(CLASSIFICATION, "RandomForest", numTrees=10, maxDepth=5)
    trained = _fit(_tiers(spark, sf_dir), "tier", CLASSIFICATION, [spec], _LINE_KEY)
    found = explain.permutation_importance(trained)
    trained.release()
    return found


@query("model_importance")
def _(spark, sf_dir):
    spec = candidate(CLASSIFICATION, "RandomForest", numTrees=10, maxDepth=5)
    trained = _fit(_tiers(spark, sf_dir), "tier", CLASSIFICATION, [spec], _LINE_KEY)
    method, found = explain.feature_importance(trained)
    trained.release()
    return explain.top_features(found).withColumn("method", F.lit(method))


_SPREAD_PARTS = [
    f"""SELECT '{x}' AS feature, abs((max(m) - any_value(g)) / any_value(s) - (min(m) - any_value(g)) / any_value(s))
    AS spread FROM (SELECT l_returnflag, avg({x}) AS m FROM lineitem GROUP BY 1),
    (SELECT avg({x}) AS g, stddev_samp({x}) AS s FROM lineitem)"""
    for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
]


@query(
    "cluster_profiles",
    f"SELECT feature, round(spread, 8) AS spread FROM ({' UNION ALL '.join(_SPREAD_PARTS)})",
)
def _(spark, sf_dir):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    found = explain.cluster_profiles(table(spark, sf_dir, "lineitem"), "l_returnflag", columns)
    return rounded(found, "spread", digits=8)


@query(
    "cluster_sizes",
    "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
)
def _(spark, sf_dir):
    from ..operators.profile import group_sizes

    return group_sizes(table(spark, sf_dir, "embeddings"), "label")


@query(
    "projection",
    """WITH s AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_linenumber) AS b,
      var_samp(l_linenumber) AS d FROM lineitem),
    e AS (SELECT a, b, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1 FROM s),
    v AS (SELECT b / sqrt(b * b + (l1 - a) ** 2) AS vx, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS vy FROM e)
    SELECT l_returnflag AS label, count(*) AS n, round(sum((l_quantity * vx + l_linenumber * vy) ** 2) / 1000, 4) AS energy
    FROM lineitem, v GROUP BY l_returnflag""",
)
def _(spark, sf_dir):
    """Squares hide the arbitrary sign of a component."""
    df = _vectors(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber")
    found = explain.projection(df, "features", "l_returnflag")
    return found.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(c("x") ** 2) / 1000, 4).alias("energy")
    )


@query("explained_clusters")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_type")
    plan = suggest_plan(df)
    specs = [candidate(ProblemType.CLUSTERING, "KMeans", k=3, restarts=1)]
    trained = training.train_unsupervised(df, plan, ProblemType.CLUSTERING, specs=specs)
    return explain.explain_clusters(trained, df)["profile"]


# --- scoring and reports ----------------------------------------------------------------------


@query("batch_score")
def _(spark, sf_dir):
    """Every line item through the saved and reloaded model."""
    df = _tiers(spark, sf_dir)
    trained = _fit(df, "tier", CLASSIFICATION, [candidate(CLASSIFICATION, "LogisticRegression")], _LINE_KEY)
    path = scratch_path(spark, "scorer")
    Scorer.of(trained).save(spark, path)
    trained.release()
    return Scorer.load(spark, path).score(df.drop("tier"), ("l_orderkey", "l_linenumber"))


@query("sample_explanations")
def _(spark, sf_dir):
    df = _prices(spark, sf_dir)
    trained = _fit(df, "net", REGRESSION, [candidate(REGRESSION, "LinearRegression")], _LINE_KEY)
    scored = Scorer.of(trained).score(df, ("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))
    trained.release()
    return explain.sample_explanations(scored, _LINE_KEY, 3)


@query("stored_leaderboard")
def _(spark, sf_dir):
    trained = _fit(_prices(spark, sf_dir), "net", REGRESSION, [candidate(REGRESSION, "LinearRegression")], _LINE_KEY)
    path = scratch_path(spark, "leaderboard")
    sinks.write_leaderboard(training.leaderboard(spark, trained), path)
    trained.release()
    return spark.read.json(path).select("rank", "name", "score")


def _full_run(spark, sf_dir):
    df = _late(spark, sf_dir)
    specs = [candidate(CLASSIFICATION, "LogisticRegression"), candidate(CLASSIFICATION, "RandomForest", numTrees=10, maxDepth=5)]
    return df, run.run(
        df, "watch", settings=training.Settings(trials=1, cv_folds=2), specs=specs, key=["o_orderkey"]
    )


@query("full_run")
def _(spark, sf_dir):
    _df, result = _full_run(spark, sf_dir)
    path = scratch_path(spark, "run")
    result.write(spark, path)
    return spark.read.parquet(f"{path}/facets/leaderboard").select("rank", "name", "score")


@query("report_summary")
def _(spark, sf_dir):
    df, result = _full_run(spark, sf_dir)
    tables = run.report(result)
    sizes = [(name, str(len(frame.columns))) for name, frame in tables.items()]
    return run.executive_summary(result, df).unionByName(spark.createDataFrame(sizes, "item string, value string"))
