"""Models against brute force and planted structure."""

import dataclasses
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import isolation, metrics, neighbors, outlier_models
from tabloom.operators.components import components
from tabloom.operators.dbscan import dbscan
from tabloom.plans import explain, heuristics, registry, run, training
from tabloom.plans.scoring import Scorer

P = heuristics.ProblemType


def frame(spark, x, **columns):
    data = pd.DataFrame({"id": range(len(x)), "features": [list(map(float, r)) for r in x], **columns})
    return spark.createDataFrame(data)


def spec(kind, name, **defaults):
    return registry.candidate(kind, name, **defaults)


def blobs(seed, sizes, centres, spread):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, spread, (n, len(c))) for n, c in zip(sizes, centres)])


# --- brute force ------------------------------------------------------------------------------


def brute_dbscan(x, eps, min_points):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= min_points
    label = np.full(len(x), -1)
    seen, groups = set(), []
    for i in np.flatnonzero(core):
        if i in seen:
            continue
        stack, group = [i], []
        seen.add(i)
        while stack:
            j = stack.pop()
            group.append(j)
            for k in np.flatnonzero(near[j] & core):
                if k not in seen:
                    seen.add(k)
                    stack.append(k)
        groups.append(group)
    groups.sort(key=lambda g: min(tuple(x[j]) for j in g))
    for n, g in enumerate(groups):
        label[g] = n
    for i in np.flatnonzero(~core):
        touched = [label[j] for j in np.flatnonzero(near[i] & core)]
        if touched:
            label[i] = min(touched)
    return label


@pytest.mark.parametrize(
    "seed,dims,eps,block", [(1, 2, 0.3, 40), (2, 2, 0.08, 25), (3, 3, 0.5, 60), (4, 1, 0.05, 30), (5, 6, 1.4, 50)]
)
def test_dbscan(spark, seed, dims, eps, block):
    centres = [[0.0] * dims, [2.0] * dims, [2.0] + [0.0] * (dims - 1)]
    x = blobs(seed, [70, 60, 40], centres, 0.25)
    # A crowded spot: copies and near copies hold a third of all rows.
    spot = np.vstack([np.repeat(x[:1], 60, axis=0), x[0] + np.random.default_rng(seed).normal(0, eps / 50, (40, dims))])
    x = np.vstack([x, spot])
    got = dbscan(frame(spark, x), eps, 5, block=block).orderBy("id").toPandas()["prediction"].to_numpy()
    assert (got == brute_dbscan(x, eps, 5)).all()


def test_dbscan_joins_boxes_across_a_gap(spark):
    """Crowded boxes that do not touch but have points within eps, and others that have not."""
    rng = np.random.default_rng(7)
    strips = [rng.uniform([c, 0], [c + 0.05, 0.05], (200, 2)) for c in (0.0, 0.9, 1.97, 2.95)]
    x = np.vstack(strips)
    for eps in (0.86, 0.93, 1.0):
        got = dbscan(frame(spark, x), eps, 5, block=100).orderBy("id").toPandas()["prediction"].to_numpy()
        assert (got == brute_dbscan(x, eps, 5)).all()


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_nearest_neighbors(spark, weights):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float) + (x[:, 2] > 1)
    train, test = np.arange(200), np.arange(200, 260)
    model = neighbors.NearestNeighbors(5, weights, block=30).fit(frame(spark, x[train], label=y[train]))
    got = model.transform(frame(spark, x[test])).orderBy("id").toPandas()["prediction"].to_numpy()
    d = np.sqrt(((x[test][:, None, :] - x[train][None, :, :]) ** 2).sum(-1))
    for i, row in enumerate(d):
        near = np.argsort(row, kind="stable")[:5]
        votes = {}
        for j in near:
            votes[y[j]] = votes.get(y[j], 0) + (1 if weights == "uniform" else 1 / row[j])
        best = min(votes, key=lambda k: (-round(votes[k], 9), k))
        assert got[i] == best


def test_nearest_neighbors_weigh_copies(spark):
    x = np.array([[0.0, 0.0]] * 40 + [[1.0, 0.0]] * 3 + [[5.0, 5.0]] * 2)
    y = np.array([1.0] * 30 + [0.0] * 10 + [2.0] * 5)
    model = neighbors.NearestNeighbors(5).fit(frame(spark, x, label=y))
    got = model.transform(frame(spark, np.array([[0.1, 0.0], [4.9, 5.0]]))).orderBy("id").collect()
    assert [r.prediction for r in got] == [1.0, 2.0]


def test_local_outlier_factor(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(150, 2)), [[6.0, 6.0]], np.repeat([[0.3, 0.2]], 30, axis=0)])
    k = 10
    got = neighbors.local_outlier_factor(frame(spark, x), k, block=40).orderBy("id").toPandas()["score"].to_numpy()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(d, order, 1)[:, -1]
    density = np.array([1 / (np.maximum(reach[o], d[i, o]).mean() + 1e-10) for i, o in enumerate(order)])
    want = np.array([density[o].mean() / density[i] for i, o in enumerate(order)])
    assert got[150] > 2
    # Equal distances among copies may pick other copies, which have the same density.
    assert np.allclose(got, want, rtol=1e-6)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1400)]
    edges = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in chain + star], "a long, b long")
    vertices = spark.createDataFrame([(i,) for i in [*range(201), *range(1000, 1400), 5000]], "id long")
    roots = {r.id: r.root for r in components(vertices, edges).collect()}
    assert all(roots[i] == 0 for i in range(201))
    assert all(roots[i] == 1000 for i in range(1000, 1400)) and roots[5000] == 5000


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(400, 2)), rng.uniform(8, 9, (8, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).withColumn("id", F.monotonically_increasing_id())
    forest = isolation.fit_isolation_forest(df)
    cols = isolation.fit_isolation_forest(df, ["a", "b"])
    scored = df.withColumn("score", cols.score(df))
    top = scored.orderBy(F.desc("score")).limit(8).toPandas()
    assert (top["a"] > 7).all()
    assert isolation.IsolationForest.from_json(cols.to_json()).nodes == cols.nodes
    assert forest.columns == ("a", "b", "id")
    flagged = isolation.flag_anomalies(scored, "score", 0.05).filter("is_anomaly").count()
    assert 8 <= flagged <= 21
    assert not isolation.anomaly_summary(df.limit(10), ["a"]).first().available


def test_mahalanobis(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]])
    x = np.column_stack([x, np.full(300, 4.0)])
    from pyspark.ml.functions import array_to_vector

    df = frame(spark, x).withColumn("features", array_to_vector("features"))
    got = outlier_models.MahalanobisEstimator(0.1).fit(df).transform(df).orderBy("id").toPandas()
    z = x[:, :3] - x[:, :3].mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.inv(np.cov(x[:, :3].T)), z))
    assert np.allclose(got["score"], want)
    assert (got["prediction"] == -1).sum() == 30


# --- training ---------------------------------------------------------------------------------


def planted(spark, n=600):
    rng = np.random.default_rng(11)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    kind = rng.choice(["a", "b", "c"], n)
    gap = np.where(rng.random(n) < 0.2, np.nan, x2)
    return spark.createDataFrame(
        pd.DataFrame({
            "row": range(n), "x1": x1.round(2), "x2": gap.round(2), "kind": kind,
            "level": (3 * x1 + rng.normal(0, 0.1, n)).round(3), "up": np.where(x1 > 0, "yes", "no"),
        })
    )


@pytest.fixture(scope="module")
def classified(spark):
    df = planted(spark).drop("level")
    plan = heuristics.suggest_plan(df, "up")
    specs = [
        spec(P.CLASSIFICATION, "LogisticRegression"),
        spec(P.CLASSIFICATION, "RandomForest", numTrees=8, maxDepth=4),
        spec(P.CLASSIFICATION, "KNN"),
        dataclasses.replace(spec(P.CLASSIFICATION, "SVM"), name="Broken", build=lambda p, c: 1 / 0),
    ]
    trained = training.train_supervised(
        df, "up", plan, P.CLASSIFICATION, training.Settings(trials=1, cv_folds=2), specs, ["row"]
    )
    yield df, trained
    trained.release()


def test_leaderboard(spark, classified):
    _df, trained = classified
    board = training.leaderboard(spark, trained).orderBy("rank").collect()
    scores = [r.score for r in board if r.score is not None]
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 1 for s in scores)
    assert board[-1].name == "Broken" and "division" in board[-1].error and board[-1].metrics == {"error": 0.0}
    assert trained.best.metrics["f1_weighted"] > 0.9 and 0 < trained.best.metrics["cv_score"] <= 1
    wide = training.leaderboard_table(training.leaderboard(spark, trained))
    assert {"accuracy", "f1_weighted", "cv_score"} <= set(wide.columns)
    assert "row" not in trained.names and "x1" in trained.names


def test_importance_ranks_the_signal_first(spark, classified):
    _df, trained = classified
    for result in trained.results[:3]:
        one = dataclasses.replace(trained, results=[result])
        _method, found = explain.feature_importance(one)
        assert explain.top_features(found).first().feature == "x1"
    shuffled = explain.permutation_importance(dataclasses.replace(trained, results=trained.results[:1]))
    assert shuffled.orderBy(F.desc("importance")).first().feature == "x1"


def test_saved_models_score_alike(spark, classified, tmp_path):
    df, trained = classified
    for result in trained.results[:3]:
        scorer = Scorer.of(dataclasses.replace(trained, results=[result]))
        path = str(tmp_path / result.name)
        scorer.save(spark, path)
        raw = df.drop("up")
        a = scorer.score(raw, ("row",))
        b = Scorer.load(spark, path).score(raw, ("row",))
        assert a.exceptAll(b).count() == 0 and b.count() == df.count()
        assert {r.predicted for r in b.select("predicted").distinct().collect()} <= {"yes", "no"}


def test_reruns_agree(spark):
    df = planted(spark).drop("up")
    plan = heuristics.suggest_plan(df, "level")
    scores = []
    for _ in range(2):
        trained = training.train_supervised(
            df, "level", plan, P.REGRESSION, training.Settings(trials=1, cv_folds=1),
            [spec(P.REGRESSION, "LinearRegression"), spec(P.REGRESSION, "GradientBoosting", maxIter=5)], ["row"],
        )
        scores.append([(r.name, round(r.metrics["r2"], 9)) for r in trained.results])
        assert trained.best.metrics["r2"] > 0.99
        trained.release()
    assert scores[0] == scores[1]


def test_search_takes_the_best_point(spark):
    df = planted(spark, 300).drop("up")
    wanted = dataclasses.replace(
        spec(P.REGRESSION, "GradientBoosting", maxIter=1), grid={"maxIter": (1, 8), "stepSize": (0.1, 0.3)}
    )
    trained = training.train_supervised(
        df, "level", heuristics.suggest_plan(df, "level"), P.REGRESSION,
        training.Settings(trials=4, cv_folds=2), [wanted], ["row"],
    )
    assert trained.best.params["maxIter"] == 8
    paths = [frame.scratch_path.removeprefix("file:") for frame in trained.scratch]
    assert len(paths) == 2 and all(os.path.exists(p) for p in paths)
    trained.release()
    assert not any(os.path.exists(p) for p in paths)
    points = training.parameter_points(next(s for s in registry.candidates(P.REGRESSION) if s.grid), 4, 42)
    assert len(points) == 4 and points == training.parameter_points(
        next(s for s in registry.candidates(P.REGRESSION) if s.grid), 4, 42
    )


def test_cluster_run(spark, tmp_path):
    x = blobs(9, [60, 60, 60], [[0, 0], [6, 6], [0, 6]], 0.4)
    df = spark.createDataFrame(pd.DataFrame(x.round(1), columns=["a", "b"])).withColumn("c", F.lit("same"))
    specs = [
        spec(P.CLUSTERING, "KMeans", k=3, restarts=2), spec(P.CLUSTERING, "DBSCAN"), spec(P.CLUSTERING, "Agglomerative", k=3),
    ]
    result = run.run(df, specs=specs)
    assert result.problem_type is P.CLUSTERING and not result.notes
    found = {r.name: r.metrics for r in result.trained.results}
    assert found["KMeans"]["n_clusters"] == 3 and found["DBSCAN"]["n_clusters"] == 3
    assert result.trained.best.metrics["silhouette_sq"] > 0.9
    sizes = [r.n for r in result.facets["clusters_sizes"].collect()]
    assert sorted(sizes) == [60, 60, 60]
    assert result.facets["clusters_verdict"].first().verdict == "good"
    result.write(spark, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "facets" / "leaderboard")).count() == 3
    told = {r.item: r.value for r in spark.read.parquet(str(tmp_path / "run" / "overview")).collect()}
    assert told["problem_type"] == "clustering" and told["status"] == "trained" and told["best_model"] in found
    again = Scorer.load(spark, str(tmp_path / "run" / "scorer")).score(df)
    assert again.groupBy("prediction").count().filter("count = 60").count() == 3
    for name in ("histograms", "boxplots", "correlations", "dataset"):
        assert result.facets[name].count() > 0
    assert set(run.report(result)) >= {"shape", "quality", "plan", "leaderboard"}
    items = {r.item for r in run.executive_summary(result, df).collect()}
    assert {"problem_type", "rows", "best_model", "top_1", "top_3"} <= items


def test_anomaly_run(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(150, 2)).round(1), [[9.0, 9.0]] * 3])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    result = run.run(df, problem_type=P.ANOMALY_DETECTION, profiled=False)
    assert [r.error for r in result.trained.results] == [None] * 3
    assert all(0 < r.metrics["n_anomalies"] < 40 for r in result.trained.results)
    # A model that labels the rows it is fitted on is saved as the labels of their features.
    lof = next(r for r in result.trained.results if r.name == "LocalOutlierFactor")
    one = Scorer(P.ANOMALY_DETECTION, lof.name, result.trained.recipe, lof.model, None, result.trained.train)
    one.save(spark, str(tmp_path / "lof"))
    again = Scorer.load(spark, str(tmp_path / "lof"))
    assert sorted(r.prediction for r in again.score(df).collect()) == sorted(r.prediction for r in one.score(df).collect())
    assert again.score(spark.createDataFrame([(100.0, 100.0)], "a double, b double")).first().prediction is None


def test_time_series_is_not_trained(spark):
    df = spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,0,id) as t, id % 5 as v from range(30)")
    df = df.select("t", F.col("v").cast("int"))
    result = run.run(df)
    assert result.problem_type is P.TIME_SERIES and result.trained is None and "time series" in result.status
    with pytest.raises(ValueError):
        registry.candidates(P.TIME_SERIES)


def test_auto_target(spark):
    df = planted(spark, 200).select("x1", "kind")
    result = run.run(
        df, auto_target=True, profiled=False, settings=training.Settings(trials=1, cv_folds=1),
        specs=[spec(P.CLASSIFICATION, "LogisticRegression")],
    )
    assert result.target == "kind" and result.problem_type is P.CLASSIFICATION


def test_own_models_can_be_registered():
    extra = registry.Candidate("Extra", P.REGRESSION, lambda p, c: None)
    registry.add_candidate(extra)
    try:
        assert registry.candidates(P.REGRESSION)[-1] is extra
    finally:
        registry._ADDED.clear()


def test_silhouette_rules(spark):
    x = blobs(6, [30, 30], [[0, 0], [9, 9]], 0.3)
    from pyspark.ml.functions import array_to_vector

    df = frame(spark, x).withColumn("features", array_to_vector("features"))
    two = df.withColumn("prediction", (F.col("id") >= 30).cast("int"))
    assert metrics.silhouette(two) > 0.9
    lone = df.withColumn("prediction", F.when(F.col("id") >= 30, -1).otherwise(0))
    assert metrics.silhouette(lone) is None and metrics.silhouette(lone, noise_counts=True) > 0.9
    assert metrics.silhouette(df.withColumn("prediction", F.lit(0))) is None
