"""Agglomerative clustering by Ward's criterion (M12): reciprocal nearest neighbours merge in rounds.

The cost of a merge depends on sizes and centroids alone, which is the update of Lance and Williams in closed form,
and a merge never brings two other clusters nearer to each other than they were to the parts. So all pairs that are
each other's nearest may merge at once, and the tree is that of merging one cheapest pair at a time; only the order in
which it is found differs. The number of rounds grows with the logarithm of the rows. Nearest clusters are found by
the cells of :mod:`.blocks`: the cost to any cluster is at least that to one of the smallest size, which bounds the
distance at which a better one can lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import col
from ..session import written
from .blocks import Cells, block_join, chunks, distances, distinct_vectors, matrix, vector_array
from .components import components
from .lookup import lookup_join

# Clusters that the driver merges the rest of: a fixed number of centroids, whatever the rows.
FINISH = 1_000
_NEAR = "id bigint, pid bigint, cost double"


def costs(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """What merging each cluster of a with each of b adds to the squared distances from the centroids."""
    size = a_size[:, None] * b_size[None, :] / (a_size[:, None] + b_size[None, :])
    return size * distances(a, b) ** 2


def _cheapest(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """Block work: the cheapest partner of each cluster, the smallest id among equals."""
    points = points.sort_values("id")
    a, b = matrix(queries["vec"]), matrix(points["vec"])
    qid, pid = queries["id"].to_numpy(), points["id"].to_numpy()
    sizes = points["weight"].to_numpy(dtype=float)
    found, cost = [], []
    for part in chunks(len(a), len(b)):
        d = costs(a[part], queries["weight"].to_numpy(dtype=float)[part], b, sizes)
        d[qid[part][:, None] == pid[None, :]] = np.inf
        best = d.argmin(axis=1)
        found.append(pid[best])
        cost.append(d[np.arange(len(best)), best])
    out = pd.DataFrame({"id": qid, "pid": np.concatenate(found), "cost": np.concatenate(cost)})
    return out[np.isfinite(out["cost"])]


def _nearest(clusters: DataFrame, block: int | None) -> DataFrame:
    """(id, pid, cost): the cheapest partner of every cluster."""
    cells, placed = Cells.build(clusters, block)
    best = F.min(F.struct("cost", "pid")).alias("best")
    home = placed.withColumn("cells", F.array("cell")).select("id", "vec", "weight", "cells")
    lean = placed.select("id", "vec", "weight", "cell")
    first = written(block_join(home, lean, cells.block, _cheapest, _NEAR).groupBy("id").agg(best).select("id", "best.*"), "near")
    if cells.single:
        return first
    smallest = float(clusters.agg(F.min("weight")).first()[0])
    size = F.col("weight")
    reach = F.sqrt(F.col("cost") * (size + smallest) / (size * smallest))
    bounded = placed.join(first.select("id", "cost"), "id", "left").withColumn("limit", F.coalesce(reach * (1 + 1e-9), F.lit(float("inf"))))
    beyond = bounded.select("id", "vec", "weight", cells.reach(bounded, F.col("limit"), F.col("cell")).alias("cells"))
    second = block_join(beyond, lean, cells.block, _cheapest, _NEAR)
    both = first.select("id", "pid", "cost").unionByName(second)
    return written(both.groupBy("id").agg(best).select("id", "best.*"), "near")


def _finish(ids: np.ndarray, vec: np.ndarray, size: np.ndarray, first_round: int) -> list[tuple[int, int, float, int]]:
    """The merges of a few clusters, by the same rounds in memory."""
    merges, order = [], np.argsort(ids)
    ids, vec, size = ids[order], vec[order], size[order]
    while len(ids) > 1:
        d = costs(vec, size, vec, size)
        np.fill_diagonal(d, np.inf)
        best = d.argmin(axis=1)
        a = np.flatnonzero((best[best] == np.arange(len(ids))) & (np.arange(len(ids)) < best))
        b = best[a]
        merges += [(int(ids[i]), int(ids[j]), float(d[i, j]), first_round) for i, j in zip(a, b)]
        vec[a] = (vec[a] * size[a, None] + vec[b] * size[b, None]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        keep = np.ones(len(ids), bool)
        keep[b] = False
        ids, vec, size = ids[keep], vec[keep], size[keep]
        first_round += 1
    return merges


def ward_merges(points: DataFrame, block: int | None = None, finish: int = FINISH) -> DataFrame:
    """(a, b, cost, round): all merges of the clusters (id, vec, weight); a cluster is named by its smallest id.

    ``cost`` is the growth of the sum of squared distances to the centroids. Among equal costs the smaller id goes
    first.
    """
    spark = points.sparkSession
    clusters, merged, turn = points.select("id", "vec", "weight"), None, 0
    while (n := clusters.count()) > finish:
        near = _nearest(clusters, block)
        back = near.select(F.col("id").alias("pid"), F.col("pid").alias("id"))
        pairs = written(near.join(back, ["id", "pid"]).filter("id < pid").select(F.col("id").alias("a"), F.col("pid").alias("b"), "cost"), "pairs")
        found = pairs.withColumn("round", F.lit(turn))
        merged = found if merged is None else merged.unionByName(found)
        # Both parts of a merge come together under its name; all others keep theirs.
        name = written(pairs.select(F.col("b").alias("id"), F.col("a").alias("name")), "names")
        named = clusters.join(name, "id", "left").withColumn("id", F.coalesce("name", "id")).drop("name")
        part = F.struct("vec", F.col("weight").cast("double").alias("w"))
        joined = named.groupBy("id").agg(F.sum("weight").alias("weight"), F.min(part).alias("x"), F.max(part).alias("y"), F.count(F.lit(1)).alias("parts"))
        mean = F.zip_with("x.vec", "y.vec", lambda p, q: (p * F.col("x.w") + q * F.col("y.w")) / (F.col("x.w") + F.col("y.w")))
        clusters = written(joined.select("id", F.when(F.col("parts") == 1, F.col("x.vec")).otherwise(mean).alias("vec"), "weight"), "clusters")
        turn += 1
    rows = clusters.collect() if n else []
    ids, size = np.array([r.id for r in rows], np.int64), np.array([r.weight for r in rows], float)
    last = _finish(ids, np.array([r.vec for r in rows], float).reshape(len(rows), -1 if rows else 1), size, turn)
    rest = spark.createDataFrame(last, "a bigint, b bigint, cost double, round int")
    return rest if merged is None else merged.unionByName(rest)


def ward_clusters(df: DataFrame, k: int, features: str = "features", block: int | None = None) -> DataFrame:
    """(__vec, prediction, __n): the cluster of each distinct vector when the tree is cut into ``k``.

    Clusters are numbered from 0 by falling size, then by their first vector. There are at most as many as distinct
    vectors. An empty table gives an empty result.
    """
    points = distinct_vectors(df, features)
    merges = written(ward_merges(points, block), "merges")
    # The k - 1 dearest merges are undone; a merge is never cheaper than those it is made of.
    order = [F.col("cost").desc(), F.col("round").desc(), F.col("a").desc()]
    undone = merges.orderBy(*order).limit(k - 1).select("a", "b")
    edges = merges.select("a", "b").join(F.broadcast(undone), ["a", "b"], "left_anti")
    roots = components(points.select("id"), edges)
    rooted = written(points.join(roots, "id"), "rooted")
    sizes = rooted.groupBy("root").agg(F.sum("weight").alias("n"), F.min("vec").alias("first")).orderBy(F.desc("n"), "first").collect()
    number = points.sparkSession.createDataFrame([(r.root, float(i)) for i, r in enumerate(sizes)], "root bigint, prediction double")
    told = rooted.join(F.broadcast(number), "root")
    return told.select(F.col("vec").alias("__vec"), F.col("prediction").cast("int").alias("prediction"), F.col("weight").alias("__n"))


@dataclass
class WardClusters:
    """M12 as a model: it labels the rows it is fitted on by ``prediction``; other vectors get none."""

    k: int = 4
    block: int | None = None
    labels: DataFrame | None = None

    def fit(self, df: DataFrame) -> "WardClusters":
        return WardClusters(self.k, self.block, written(ward_clusters(df, self.k, block=self.block), "labels"))

    def transform(self, df: DataFrame) -> DataFrame:
        held = df.withColumn("__vec", vector_array(df, "features"))
        return lookup_join(held, self.labels.select("__vec", col("prediction"), "__n"), "__vec").drop("__vec")
