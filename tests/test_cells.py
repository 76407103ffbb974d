"""The pivot tree: cells of bounded size, every near pair met, pairs growing nearly with the points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import blocks
from tabloom.operators.blocks import Cells, pairs_compared


def points_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "id bigint, vec array<double>, weight bigint").repartition(4)


@pytest.mark.parametrize(("dims", "sample"), [(1, 20_000), (2, 20_000), (5, 20_000), (2, 100), (3, 1)])
def test_reach_misses_no_near_point(spark, dims, sample, monkeypatch):
    """Also where the points lie at a few spots, most of the tree is below one node, or it is grown step by step."""
    monkeypatch.setattr(blocks, "FAN", 4)
    monkeypatch.setattr(blocks, "SAMPLE", sample)
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(300, dims)), rng.normal(scale=0.01, size=(500, dims)) + 3])
    cells, placed = Cells.build(points_of(spark, x), block=20)
    rows = placed.withColumn("home", cells.home(placed)).withColumn("open", cells.reach(placed, F.lit(0.05))).collect()
    assert all(r["cell"] == r.home for r in rows) and len(rows) == 800
    sizes = np.bincount([r["cell"] for r in rows])
    assert sizes.max() <= 40
    # Cells are leaves, and a point's home is its cell.
    assert not set(np.flatnonzero(sizes)) & set(cells.children)
    cell_of = {r.id: r["cell"] for r in rows}
    for r in rows[::7]:
        near = np.flatnonzero(np.sqrt(((x - x[r.id]) ** 2).sum(axis=1)) <= 0.05)
        assert {cell_of[i] for i in near} <= set(r.open)


def test_pairs_grow_nearly_with_the_points(spark):
    """Both passes of a search for five neighbours in two dimensions."""
    rng = np.random.default_rng(4)
    counts = []
    for n in (2_000, 4_000, 8_000):
        x = rng.random((n, 2))
        cells, placed = Cells.build(points_of(spark, x), block=64)
        limit = float(2 * np.sqrt(5 / (np.pi * n)))
        counts.append(pairs_compared(placed.withColumn("cells", F.array("cell")), placed)
                      + pairs_compared(placed.withColumn("cells", cells.reach(placed, F.lit(limit), F.col("cell"))), placed))
    assert counts[1] < counts[0] * 2**1.3 and counts[2] < counts[1] * 2**1.3


def test_few_points_and_a_small_tree(spark, monkeypatch):
    one, placed = Cells.build(points_of(spark, np.zeros((1, 3))))
    assert one.single and placed.first()["cell"] == 0
    none, placed = Cells.build(points_of(spark, np.zeros((0, 3))))
    assert none.single and placed.count() == 0
    monkeypatch.setattr(blocks, "TREE_BYTES", 1)
    monkeypatch.setattr(blocks, "SAMPLE", 100)
    monkeypatch.setattr(blocks, "FAN", 16)
    cells, placed = Cells.build(points_of(spark, np.random.default_rng(1).normal(size=(500, 2))), block=5)
    assert placed.groupBy("cell").count().agg(F.max("count")).first()[0] > 10
