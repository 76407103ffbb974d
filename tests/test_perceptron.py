"""Perceptrons: gradients against finite differences, the penalty, sums of many tasks, saved models."""

import numpy as np
import pandas as pd
import pytest

from tabloom.operators.perceptron import Net, Perceptron, PerceptronModel, descend, gradient_sums
from tabloom.plans import registry
from tabloom.plans.heuristics import ProblemType as P


def rings(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1 + 1.5 * label + rng.normal(0, 0.1, n)
    x = np.c_[radius * np.cos(angle), radius * np.sin(angle)]
    return spark.createDataFrame(pd.DataFrame({"features": x.tolist(), "label": label.astype(float)})), x, label


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 4, 40)
    net = Net.draw((3, 7, 5, 4), 2)
    net.flat += rng.normal(0, 0.1, len(net.flat))

    def value(flat):
        here = Net(net.layers, flat)
        return here.sums(x, y)[0] + here.penalty(0.3)[0]

    gradient = net.sums(x, y)[1] + net.penalty(0.3)[1]
    for i in rng.choice(len(net.flat), 60, replace=False):
        step = np.zeros_like(net.flat)
        step[i] = 1e-6
        assert gradient[i] == pytest.approx((value(net.flat + step) - value(net.flat - step)) / 2e-6, abs=1e-4)


def test_sums_do_not_depend_on_the_tasks(spark):
    df, x, label = rings(spark)
    lean = df.selectExpr("features as x", "cast(label as int) as y")
    net = Net.draw((2, 6, 2), 5)
    want = net.sums(x, label)
    for parts, said in ((1, 1), (9, 9), (9, 100)):
        loss, n, gradient = gradient_sums(lean.repartition(parts), net, said)
        assert n == len(x) and loss == pytest.approx(want[0]) and np.allclose(gradient, want[1])


def test_descent_finds_the_least_value():
    scale = np.array([1.0, 10.0, 100.0])
    at, values = descend(lambda v: (float((scale * (v - 3) ** 2).sum()), 2 * scale * (v - 3)), np.zeros(3), 200, 1e-12)
    assert np.allclose(at, 3, atol=1e-3) and values == sorted(values, reverse=True)


def test_rings_penalty_and_saved_model(spark, tmp_path):
    df, _, label = rings(spark)
    df = df.coalesce(2).cache()
    model = Perceptron((12,), 1e-4, 2, 60).fit(df)
    scored = model.transform(df).select("prediction", "label", "probability").collect()
    assert np.mean([r.prediction == r.label for r in scored]) > 0.97
    assert all(sum(r.probability) == pytest.approx(1) for r in scored)
    tight = Perceptron((12,), 300.0, 2, 60).fit(df)
    length = [sum((w**2).sum() for w, _ in m.net.pairs()) for m in (model, tight)]
    assert length[1] < 0.2 * length[0]
    model.save(str(tmp_path / "net"), spark)
    again = PerceptronModel.load(spark, str(tmp_path / "net"))
    assert [r.prediction for r in again.transform(df).collect()] == [r.prediction for r in scored]
    with pytest.raises(ValueError, match="no rows"):
        Perceptron().fit(df.limit(0))


def test_registry_searches_the_penalty():
    spec = next(s for s in registry.candidates(P.CLASSIFICATION) if s.name == "MLP")
    assert spec.grid["alpha"] == (1e-4, 1e-3)
    built = spec.build({"hidden": (64,), "alpha": 1e-3}, registry.Context(10, 4, 3, 7))
    assert (built.hidden, built.alpha, built.n_classes, built.seed) == ((64,), 1e-3, 3, 7)
