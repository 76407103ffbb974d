"""Permutation importance of forests: predicted inside the task, as Spark predicts, in one pass."""

import types

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabloom.operators import forest
from tabloom.plans import explain
from tabloom.plans.heuristics import ProblemType


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 7, size=(1_200, 5)).astype(float)
    x[::50, 3] = np.nan
    y = np.where(x[:, 0] > 3, 2.0, (x[:, 1] + x[:, 2] > 6).astype(float))
    y[rng.random(1_200) < 0.1] = 1.0
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").select(
        array_to_vector("x").alias("features"), "label").repartition(3).localCheckpoint()


def _clean(rows):
    return rows.filter(~F.exists(vector_to_array("features"), F.isnan)).localCheckpoint()


def _trained(rows, model, kind):
    best = types.SimpleNamespace(model=model)
    return types.SimpleNamespace(names=[f"f{i}" for i in range(5)], valid=rows, problem_type=kind, best=best)


@pytest.mark.parametrize("depth", [0, 6])
@pytest.mark.parametrize("kind", [ProblemType.CLASSIFICATION, ProblemType.REGRESSION])
def test_importance_is_that_of_transformed_rows(spark, rows, kind, depth, monkeypatch):
    estimator = RandomForestClassifier if kind is ProblemType.CLASSIFICATION else RandomForestRegressor
    model = estimator(numTrees=7, maxDepth=depth, seed=3).fit(_clean(rows))
    told = model.transform(rows).select(vector_to_array("features").alias("x"), "prediction").collect()
    own, x = forest.forest_of(model, spark), np.array([r.x for r in told])
    leaves = own.leaves(x)
    assert own.predict(leaves).tolist() == [r.prediction for r in told]
    changed = x.copy()
    changed[:, 1] = changed[::-1, 1]
    assert all((a == b).all() for a, b in zip(own.leaves_without(changed, leaves, 1), own.leaves(changed)))
    trained = _trained(_clean(rows), model, kind)
    got = explain.permutation_importance(trained).collect()
    monkeypatch.setattr(explain, "forest_of", lambda *x: None)
    want = explain.permutation_importance(trained).collect()
    assert [r.feature for r in got] == [r.feature for r in want]
    assert np.allclose([r.importance for r in got], [r.importance for r in want], rtol=0, atol=1e-12)
    assert depth == 0 or max(r.importance for r in got) > 0.1


@pytest.mark.parametrize("estimator", [lambda: RandomForestClassifier(numTrees=3, seed=1), lambda: LogisticRegression(maxIter=3)])
def test_rows_are_shuffled_once(spark, rows, estimator, monkeypatch):
    clean = _clean(rows)
    seen = spark.sparkContext.accumulator(0)
    model, shuffle = estimator().fit(clean), np.random.default_rng

    class Counted:
        def __init__(self, seed):
            self.rng = shuffle(seed)

        def permutation(self, n):
            seen.add(n)
            return self.rng.permutation(n)

    rows_of, forest_of = explain._shuffled_rows, explain._shuffled_forest

    def counting(make):
        def made(*more):
            run = make(*more)

            def counted(batches):
                np.random.default_rng = Counted
                try:
                    yield from run(batches)
                finally:
                    np.random.default_rng = shuffle

            return counted

        return made

    monkeypatch.setattr(explain, "_shuffled_rows", counting(rows_of))
    monkeypatch.setattr(explain, "_shuffled_forest", counting(forest_of))
    explain.permutation_importance(_trained(clean, model, ProblemType.CLASSIFICATION))
    assert seen.value == 3 * 5 * clean.count()
