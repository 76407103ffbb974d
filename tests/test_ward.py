"""Ward's tree against merging one cheapest pair at a time."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import ward
from tabloom.operators.blocks import distinct_vectors


def frame(spark, x):
    return spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").repartition(4).select(array_to_vector("x").alias("features"))


def plain(x, k):
    """(costs of all merges in order, sets of rows of the k clusters)."""
    groups, out = [[i] for i in range(len(x))], []
    cut = None
    while True:
        if len(groups) == k:
            cut = {frozenset(g) for g in groups}
        if len(groups) == 1:
            return out, cut
        means, sizes = np.array([x[g].mean(axis=0) for g in groups]), np.array([len(g) for g in groups], float)
        d = ((means[:, None] - means[None]) ** 2).sum(axis=2) * sizes[:, None] * sizes[None] / (sizes[:, None] + sizes[None])
        np.fill_diagonal(d, np.inf)
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        out.append(d[i, j])
        groups[i] += groups.pop(j)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_same_tree(spark, k, monkeypatch):
    """Rounds over many cells, the last clusters in memory."""
    monkeypatch.setattr(ward, "FINISH", 20)
    rng = np.random.default_rng(8)
    centres = rng.normal(scale=4, size=(7, 2))
    x = np.round(centres[rng.integers(0, 7, 300)] + rng.normal(size=(300, 2)), 6)
    df = frame(spark, x)
    merges = ward.ward_merges(distinct_vectors(df), block=30, finish=20).collect()
    want, clusters = plain(x, k)
    assert np.allclose(sorted(m.cost for m in merges), sorted(want))
    # A round merges a good part of what is left.
    assert max(m["round"] for m in merges) < 4 * np.log2(300)
    got = ward.WardClusters(k, block=30).fit(df).transform(df).collect()
    place = {tuple(r): i for i, r in enumerate(x)}
    parts = {}
    for r in got:
        parts.setdefault(r.prediction, set()).add(place[tuple(r.features.toArray())])
    assert {frozenset(p) for p in parts.values()} == clusters
    assert [len(parts[i]) for i in sorted(parts)] == sorted((len(p) for p in clusters), reverse=True)


def test_copies_ties_and_few_rows(spark):
    grid = [(i, j) for i in range(6) for j in range(6)]
    df = frame(spark, np.array(grid * 5 + [(100.0, 100.0)] * 50))
    one, two = (ward.WardClusters(2).fit(df).transform(df).groupBy("prediction").count().orderBy("prediction").collect() for _ in range(2))
    assert one == two and [r["count"] for r in one] == [180, 50]
    same = ward.WardClusters(3).fit(frame(spark, np.zeros((9, 2))))
    assert same.transform(frame(spark, np.zeros((9, 2)))).select("prediction").distinct().collect() == [(0,)]
    none = frame(spark, np.zeros((1, 2))).limit(0)
    assert ward.WardClusters(3).fit(none).transform(none).count() == 0
    assert ward.WardClusters(2).fit(df).transform(frame(spark, [(7.5, 7.5)])).first().prediction is None


def test_large_clusters_do_not_hide_small_ones(spark):
    """The nearest by cost is not the nearest by distance."""
    x = np.array([[0.0, 0.0]] * 900 + [[1.0, 0.0]] + [[-1.5, 0.0]] * 2)
    merges = ward.ward_merges(distinct_vectors(frame(spark, x)), block=1, finish=1).orderBy("round", "cost").collect()
    assert np.allclose(sorted(m.cost for m in merges), sorted([900 / 901, 901 * 2 / 903 * (1.5 + 1 / 901) ** 2]))


def test_weights(spark):
    df = frame(spark, np.array([[0.0]] * 3 + [[1.0]] + [[5.0]]))
    table = ward.ward_clusters(df, 2)
    assert {(r["__vec"][0], r.prediction, r["__n"]) for r in table.collect()} == {(0.0, 0, 3), (1.0, 0, 1), (5.0, 1, 1)}
    assert table.agg(F.sum("__n")).first()[0] == 5
