"""Histogram boosting and SHAP values against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tabloom import session
from tabloom.operators import boosting, shap
from tabloom.operators.boosting import BoostedModel, BoostedTrees, Node, best_first
from tabloom.plans import training
from tabloom.plans.heuristics import ProblemType, suggest_plan
from tabloom.plans.registry import candidate


def frame(spark, x, y, parts=3):
    rows = [([float(v) for v in a], None if b is None else float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, label double").repartition(parts).select(array_to_vector("x").alias("features"), "label")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 4)), 1)
    return x, (x[:, 0] > 0.3).astype(int) + (x[:, 1] + 0.5 * x[:, 2] > 0)


def plain_rounds(x, y, k, rounds, step, leaves, depth, least_h=1.0, l2=1.0):
    """Boosting one leaf at a time on the raw values: margins of the rows after each round."""
    share = np.bincount(y, minlength=k) / len(y)
    margin = np.tile(np.log(share), (len(y), 1))
    for _ in range(rounds):
        p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
        add = np.zeros_like(margin)
        for c in range(k):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])

            def best(rows, level, g=g, h=h):
                found = (1e-12, None)
                if depth is not None and level >= depth:
                    return found
                for j in range(x.shape[1]):
                    for cut in np.unique(x[rows, j])[:-1]:
                        left = rows & (x[:, j] <= cut)
                        right = rows & ~left
                        if min(h[left].sum(), h[right].sum()) < least_h:
                            continue
                        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
                        gain = score(left) + score(right) - score(rows)
                        if gain > found[0] + 1e-9:
                            found = (gain, (left, right))
                return found

            todo = [(np.ones(len(y), bool), 0)]
            options = [best(*todo[0])]
            while len(todo) < leaves and max(o[0] for o in options) > 1e-12:
                i = int(np.argmax([o[0] for o in options]))
                if options[i][1] is None:
                    break
                (left, right), level = options[i][1], todo[i][1]
                todo[i : i + 1] = [(left, level + 1), (right, level + 1)]
                options[i : i + 1] = [best(left, level + 1), best(right, level + 1)]
            for rows, _ in todo:
                add[rows, c] = -step * g[rows].sum() / (h[rows].sum() + l2)
        margin += add
    return margin


@pytest.mark.parametrize(("leaves", "depth"), [(5, None), (1 << 30, 2)])
def test_three_classes_as_one_leaf_at_a_time(spark, data, leaves, depth, monkeypatch):
    """Also over a rewrite of the margins."""
    monkeypatch.setattr(boosting, "REWRITE", 2)
    x, y = data
    model = BoostedTrees(3, 0.3, depth, None if leaves > 1000 else leaves, n_classes=3, bins=255).fit(frame(spark, x, y))
    want = plain_rounds(x, y, 3, 3, 0.3, leaves, depth)
    assert np.allclose(model.margins(x), want, atol=1e-9)
    if depth:
        # All classes share the passes: one per level, where one-vs-rest takes one per level and class.
        assert model.passes == 3 * depth


def test_best_first_takes_the_greatest_gain():
    def node(gain, *children):
        return Node(0, split=None if gain is None else (gain, 0, 0), children=children or None)

    root = node(1.0, node(5.0, node(2.0), node(None)), node(4.0, node(9.0), node(3.0)))
    assert [n.split[0] for n in best_first(root, 5)] == [1.0, 5.0, 4.0, 9.0]
    assert best_first(root, 1) == [] and best_first(node(None), 9) == []


def test_two_classes_numbers_and_a_saved_model(spark, data, tmp_path):
    x, y = data
    two = BoostedTrees(20, 0.3, 3, n_classes=2).fit(frame(spark, x, y > 0))
    scored = two.transform(frame(spark, x, y > 0))
    assert scored.filter("prediction = label").count() > 590
    assert scored.filter("(probability[1] > 0.5) <> (prediction = 1)").count() == 0
    target = 3 * x[:, 0] + (x[:, 3] > 0)
    line = BoostedTrees(40, 0.3, 3).fit(frame(spark, x, target))
    error = np.mean((line.margins(x)[:, 0] - target) ** 2)
    assert error < 0.02 * target.var()
    line.save(str(tmp_path / "m"), spark)
    again = BoostedModel.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.margins(x), line.margins(x)) and again.featureImportances == line.featureImportances
    assert line.featureImportances.toArray().argmax() == 0


def test_odd_rows(spark, data):
    x, y = data
    gaps = np.where(np.arange(600)[:, None] % 5 == 0, np.nan, x)
    model = BoostedTrees(3, 0.3, 3, n_classes=3).fit(frame(spark, gaps, [None if i % 7 == 0 else v for i, v in enumerate(y)]))
    assert model.transform(frame(spark, gaps, y)).filter("prediction is null").count() == 0
    flat = BoostedTrees(3).fit(frame(spark, x, np.full(600, 7.0)))
    assert flat.rounds == [] and flat.transform(frame(spark, x, y)).select("prediction").distinct().collect()[0][0] == 7.0
    one = BoostedTrees(3, n_classes=3).fit(frame(spark, x, np.zeros(600)))
    assert one.transform(frame(spark, x, y)).filter("prediction <> 0").count() == 0
    same = BoostedTrees(3).fit(frame(spark, np.zeros((600, 2)), y))
    assert same.rounds == []
    with pytest.raises(ValueError):
        BoostedTrees(3).fit(frame(spark, x, y).limit(0))
    assert model.transform(frame(spark, x, y).limit(0)).count() == 0


def plain_shap(leaves, x, k):
    """Shapley values by all subsets, the prediction with a subset being the mean over paths it does not decide."""
    d = x.shape[1]

    def known(subset, row):
        total = leaves.base[k]
        for i in range(len(leaves.depth)):
            term = leaves.value[i, k]
            for j in range(leaves.depth[i]):
                f = leaves.feature[i, j]
                inside = leaves.low[i, j] < row[f] <= leaves.high[i, j]
                term *= float(inside) if f in subset else leaves.share[i, j]
            total += term
        return total

    out = np.zeros((len(x), d))
    for r, row in enumerate(x):
        for j in range(d):
            others = [f for f in range(d) if f != j]
            for size in range(d):
                weight = shap.factorial(size) * shap.factorial(d - size - 1) / shap.factorial(d)
                for s in itertools.combinations(others, size):
                    out[r, j] += weight * (known({*s, j}, row) - known(set(s), row))
    return out


def test_shap_by_subsets(spark, data):
    x, y = data
    df = frame(spark, x, y)
    forest = RandomForestClassifier(numTrees=3, maxDepth=4, seed=1).fit(df)
    models = [
        BoostedTrees(3, 0.3, 4, n_classes=3).fit(df), BoostedTrees(2, 0.3, None, 7).fit(df), forest, DecisionTreeRegressor(maxDepth=5).fit(df),
    ]
    for model in models:
        leaves = shap.leaves_of(model, spark)
        got = leaves.values(x[:12])
        for k in range(got.shape[2]):
            assert np.allclose(got[..., k], plain_shap(leaves, x[:12], k), atol=1e-9)
    some = shap.shap_values(df, forest).withColumn("features", array_to_vector("x"))
    scored = forest.transform(some)
    expected = shap.leaves_of(forest, spark).expected()
    sums = scored.select("shap", F.col("probability")).collect()
    assert all(np.allclose([sum(k) for k in r.shap] + expected, r.probability.toArray(), atol=1e-9) for r in sums)


def test_mean_shap(spark, data):
    x, y = data
    df = frame(spark, x, y)
    model = BoostedTrees(3, 0.3, 3, n_classes=3).fit(df)
    want = np.abs(shap.leaves_of(model, spark).values(x)).mean(axis=(0, 2))
    got = {r.feature: r.importance for r in shap.mean_abs_shap(df, model, list("abcd")).collect()}
    assert np.allclose([got[c] for c in "abcd"], want) and got["d"] < got["a"]
    assert {r.importance for r in shap.mean_abs_shap(df.limit(0), model, list("abcd")).collect()} == {0.0}
    nan = shap.leaves_of(model, spark).values(np.full((1, 4), np.nan))
    assert np.allclose(nan, shap.leaves_of(model, spark).values(np.full((1, 4), 1e9)))


def test_rows_with_equal_bins_are_one(spark, data):
    """A pass reads each combination of bins once, however many rows have it, and goes to all cores where there are many."""
    x, y = data
    few = np.clip(np.round(x), -1, 1) + 0.0
    often = frame(spark, np.repeat(few, 5, axis=0), np.repeat(y, 5), 1)
    for n_classes, target in ((0, y * 1.0), (2, y > 0), (3, y)):
        trees = BoostedTrees(3, 0.3, 3, n_classes=n_classes)
        combined, _, _ = trees.prepared(frame(spark, np.repeat(few, 5, axis=0), np.repeat(target, 5), 1))
        n = np.concatenate([np.frombuffer(r.n, float) for r in combined.collect()])
        assert len(n) == len(np.unique(few, axis=0)) and n.sum() == 3_000
    model = BoostedTrees(3, 0.3, 3, n_classes=3).fit(often)
    assert np.allclose(model.margins(few), plain_rounds(np.repeat(few, 5, axis=0), np.repeat(y, 5), 3, 3, 0.3, 1 << 30, 3)[::5], atol=1e-9)


def test_one_file_is_trained_on_by_all_cores(spark, monkeypatch):
    """The rows of one task are dealt out before they are read once per tree level."""
    monkeypatch.setattr(session, "SHARED_ROWS", 50)
    df = spark.range(2_000).select("id", (F.col("id") * 7 % 31).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("kind")).coalesce(1)
    chosen = [candidate(ProblemType.CLASSIFICATION, "BoostedTrees", maxIter=1, maxDepth=2)]
    trained = training.train_supervised(df, "kind", suggest_plan(df, "kind"), ProblemType.CLASSIFICATION, training.Settings(trials=1, cv_folds=1), chosen, ["id"])
    assert trained.train.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert trained.train.count() + trained.valid.count() == 2_000
    trained.release()
    assert session.tasks_for(spark, 10) == 1 and session.tasks_for(spark, 10**9) == 250


def test_a_pass_over_few_groups_needs_no_shuffle(spark, data, monkeypatch):
    """The trees are those that several tasks find."""
    x, y = data
    rows = frame(spark, x, y + x[:, 3])
    dealt, plain = [], type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda df, *how: dealt.append(how) or plain(df, *how))
    monkeypatch.setattr(boosting, "REWRITE", 2)
    one = BoostedTrees(3, 0.3, 3).fit(rows)
    assert one.passes == 9 and dealt == []
    monkeypatch.setattr(session, "SHARED_ROWS", 100)
    several = BoostedTrees(3, 0.3, 3).fit(rows)
    assert len([how for how in dealt if how[1:] == ("slot", "feature")]) == 9
    assert np.allclose(one.margins(x), several.margins(x))
