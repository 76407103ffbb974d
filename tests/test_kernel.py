"""Kernel machines: the estimate of the kernel, rings that no line parts, the share that is flagged."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import kernel
from tabloom.operators.kernel import FourierFeatures, KernelClassifier, KernelModel, OneClassMachine, OneClassModel
from tabloom.operators.outlier_models import MahalanobisEstimator


def frame(spark, x, y=None):
    y = np.zeros(len(x)) if y is None else y
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, label double").repartition(3).select(array_to_vector("x").alias("features"), "label")


def rings(rng, n):
    angle, inner = rng.uniform(0, 2 * np.pi, n), rng.random(n) < 0.5
    radius = np.where(inner, 1.0, 3.0) + rng.normal(scale=0.1, size=n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), inner.astype(float)


def test_kernel_estimate(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    exact = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    for size, bound in ((500, 0.2), (50_000, 0.02)):
        z = FourierFeatures.draw(3, 0.7, size, 5).of(x)
        assert np.abs(z @ z.T - exact).max() < bound
    # One over features times variance, over all values of all features.
    drawn = FourierFeatures.fit(frame(spark, x * [1, 2, 3] + 5), size=20_000)
    gamma = 1 / (3 * (x * [1, 2, 3]).var() + 0)
    want = 1 / (3 * (x * [1, 2, 3] + 5).var())
    assert abs(drawn.weights.var() / 2 - want) < 0.05 * want and gamma > 0


def test_rings(spark, tmp_path):
    x, y = rings(np.random.default_rng(2), 600)
    df = frame(spark, x, y)
    shares = {}
    for kernel in ("rbf", "linear"):
        model = KernelClassifier(kernel, 0.001).fit(df)
        shares[kernel] = model.transform(df).filter("prediction = label").count() / 600
        model.save(str(tmp_path / kernel), spark)
        again = KernelModel.load(spark, str(tmp_path / kernel))
        assert again.transform(df).filter("prediction = label").count() / 600 == shares[kernel]
    assert shares["rbf"] > 0.95 and shares["linear"] < 0.7
    three = frame(spark, x, y + (x[:, 0] > 2.0) * 2)
    model = KernelClassifier("rbf", 0.001, n_classes=3).fit(frame(spark, x, np.where(x[:, 0] > 2.0, 2.0, y)))
    assert model.transform(three).filter("prediction = label or prediction = 2").count() > 550
    assert model.transform(df.limit(0)).count() == 0


def test_a_task_holds_a_bounded_share_of_the_mapped_rows(spark, monkeypatch):
    """The linear fit of one file of rows gets them in many tasks, all of them."""
    seen = []
    fit = kernel.classification.LinearSVC.fit
    monkeypatch.setattr(kernel, "_TASK_BYTES", 40 * 8 * 50)
    monkeypatch.setattr(kernel.classification.LinearSVC, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df))
    x, y = rings(np.random.default_rng(4), 600)
    df = frame(spark, x, y).coalesce(1)
    model = KernelClassifier("rbf", 0.001, size=40).fit(df)
    assert seen == [(12, 600)]
    assert model.transform(df).filter("prediction = label").count() > 570


def plain_one_class(z, nu, steps):
    """Frank-Wolfe on the weights of all rows."""
    n = len(z)
    a = np.full(n, 1 / n)
    for _ in range(steps):
        w = a @ z
        low = np.argsort(z @ w)[: round(nu * n)]
        v = z[low].mean(axis=0)
        step = np.clip(w @ (w - v) / ((w - v) @ (w - v)), 0, 1)
        a *= 1 - step
        a[low] += step / len(low)
    return a @ z, a


@pytest.mark.parametrize("nu", [0.05, 0.2])
def test_one_class(spark, nu, tmp_path):
    rng = np.random.default_rng(3)
    x = rings(rng, 1_000)[0]
    x = x[np.linalg.norm(x, axis=1) > 2]
    df = frame(spark, x)
    machine = OneClassMachine(nu, gamma=1.0, steps=12)
    model = machine.fit(df)
    flagged = model.transform(df).filter("prediction = -1").count() / len(x)
    assert abs(flagged - nu) <= 0.01
    # The centre of a ring is strange to the machine and the most usual place to an ellipsoid.
    centre = frame(spark, np.zeros((1, 2)))
    assert model.transform(centre).first().prediction == -1
    assert MahalanobisEstimator(nu).fit(df).transform(centre).first().prediction == 1
    w, a = plain_one_class(model.features.of(x), nu, 12)
    assert a.max() <= 1 / (nu * len(x)) * 1.05 and abs(a.sum() - 1) < 1e-9
    # Each step of both shortens the mean; quantiles may part rows on the line.
    assert abs(model.w @ model.w - w @ w) < 0.02 * (w @ w)
    model.save(str(tmp_path / "m"), spark)
    again = OneClassModel.load(spark, str(tmp_path / "m"))
    assert again.transform(df).agg(F.sum("score")).first() == model.transform(df).agg(F.sum("score")).first()


def test_odd_rows(spark):
    same = frame(spark, np.ones((20, 2)))
    model = OneClassMachine(0.1, steps=3).fit(same)
    assert model.transform(same).filter("prediction = -1").count() == 0
    with pytest.raises(ValueError):
        OneClassMachine().fit(same.limit(0))
