"""Nearest neighbours in many dimensions, where distances rule few cells out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import neighbors
from tabloom.operators.blocks import NearPairs, distances


@pytest.mark.parametrize(("scale", "shift"), [(1.0, 0.0), (1e-3, 1e8), (1e30, 0.0), (1e-30, 5.0), (1e200, 0.0), (1e-200, 0.0), (0.0, 3.0)])
@pytest.mark.parametrize("dims", [1, 2, 64])
def test_no_pair_within_the_bound_is_ruled_out(scale, shift, dims):
    rng = np.random.default_rng(dims)
    a, b = (rng.normal(size=(n, dims)).round(1) * scale + shift for n in (60, 300))
    with np.errstate(over="ignore", invalid="ignore"):
        d = distances(a, b)
        # Bounds are distances that occur, so that ties count.
        bound = np.sort(d, axis=1)[:, 4]
        bound[:3] = np.inf, 0.0, d[2].max()
        got = sorted((r, c, x) for part in NearPairs(a, b).within(np.arange(60), slice(0, 300), bound) for r, c, x in zip(*part))
        assert got == [(r, c, d[r, c]) for r, c in np.argwhere(d <= bound[:, None])]


def test_values_that_are_no_numbers():
    a, b = np.array([[0.0, 1.0], [np.nan, 0.0]]), np.array([[0.0, 1.0], [1.0, np.nan], [0.0, 2.0]])
    got = [(r, c) for part in NearPairs(a, b).within(np.arange(2), slice(0, 3), np.array([2.0, 2.0])) for r, c, _ in zip(*part)]
    assert got == [(0, 0), (0, 2)]


@pytest.mark.parametrize("same", [False, True])
def test_a_query_is_not_sent_to_every_cell(spark, monkeypatch, same):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1_500, 32)).astype(np.float32).astype(float)
    # Copies, a crowd around one point, and ties.
    x[:40], x[40:300], x[300:310] = x[0], x[40] + rng.integers(-1, 2, size=(260, 32)) * 0.125, x[301]
    frame = lambda rows: spark.createDataFrame([(i, x[i].tolist()) for i in rows], "id bigint, features array<double>")
    sent, join = [], neighbors.block_join

    def counted(queries, *more):
        sent.append(queries.select(F.explode("cells")).count())
        return join(queries, *more)

    monkeypatch.setattr(neighbors, "block_join", counted)
    points = neighbors.distinct_vectors(frame(range(0 if same else 300, 1_500)))
    queries = points if same else neighbors.distinct_vectors(frame(range(300)))
    cells, placed = neighbors.Cells.build(points, 20)
    got = neighbors.nearest(queries, cells, placed, 6, same).collect()
    # Each cell alone would get about three times as many.
    leaves = len(set(range(len(cells.parent))) - set(cells.parent.tolist()))
    assert leaves > 70 and sent[1] < 0.4 * sent[0] * leaves, (sent, leaves)
    held, asked = ({r.id: (np.array(r.vec), r.weight) for r in t.collect()} for t in (points, queries))
    ids = np.array(sorted(held))
    d = distances(np.array([v for v, _ in asked.values()]), np.array([held[i][0] for i in ids]))
    for row, q in zip(d, asked):
        want, have = [], 0
        for far, i in sorted(zip(row, ids)):
            copies = held[i][1] - int(same and i == q)
            if have < 6 and copies:
                want.append((i, far, min(copies, 6 - have)))
                have += copies
        assert sorted((r.rank, r.pid, r.distance, r.weight) for r in got if r.id == q) == [(n, *w) for n, w in enumerate(want, 1)]
