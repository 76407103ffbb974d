"""Density clusters (M13; Ester et al., 1996), exact, for tables of any size.

Points are first put into small boxes whose neighbours still lie within ``eps``. A box that holds
``min_points`` rows consists of core points that belong together, so a crowded spot is one vertex and its
pairs are never compared. Only points of thinner boxes are compared with their surroundings, block by
block. Clusters are the connected components of the vertices.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .blocks import Cells, block_join, chunks, distances, distinct_vectors, matrix, vector_array
from .components import components
from .encoders import ranked
from .lookup import lookup_join
from .metrics import NOISE


class Forest:
    """Union of vertices inside one task; passes on one edge per joined vertex."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, v: int) -> int:
        root = v
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[v] != root:
            self.parent[v], v = root, self.parent[v]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        moved = [v for v in self.parent if self.find(v) != v]
        return moved, [self.find(v) for v in moved]


def _count_near(eps: float):
    def work(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(queries["vec"]), matrix(points["vec"])
        weight = points["weight"].to_numpy(dtype=np.int64)
        near = [(distances(a[part], b) <= eps) @ weight for part in chunks(len(a), len(b))]
        return pd.DataFrame({"id": queries["id"].to_numpy(), "near": np.concatenate(near)})

    return work


def _link_near(eps: float):
    def work(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(queries["vec"]), matrix(points["vec"])
        qv, pv = queries["vertex"].to_numpy(), points["vertex"].to_numpy()
        forest = Forest()
        for part in chunks(len(a), len(b)):
            close = distances(a[part], b) <= eps
            for i, row in enumerate(close):
                for other in np.unique(pv[row]):
                    forest.join(int(qv[part.start + i]), int(other))
        moved, roots = forest.edges()
        return pd.DataFrame({"a": moved, "b": roots})

    return work


def _label_near(eps: float):
    def work(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(queries["vec"]), matrix(points["vec"])
        label = points["label"].to_numpy(dtype=np.int64)
        none = np.iinfo(np.int64).max
        best = [
            np.where(distances(a[part], b) <= eps, label[None, :], none).min(axis=1)
            for part in chunks(len(a), len(b))
        ]
        out = pd.DataFrame({"id": queries["id"].to_numpy(), "label": np.concatenate(best)})
        return out[out["label"] != none]

    return work


def _box_pairs(eps: float):
    """Pairs of boxes: certain ones become edges, open ones are passed on for a look at their points."""

    def work(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        a_low, a_high = matrix(queries["low"]), matrix(queries["high"])
        b_low, b_high = matrix(points["low"]), matrix(points["high"])
        qv, pv = queries["id"].to_numpy(), points["id"].to_numpy()
        forest, maybe = Forest(), []
        for part in chunks(len(a_low), len(b_low)):
            nearest = np.zeros((part.stop - part.start, len(b_low)))
            farthest = np.zeros_like(nearest)
            for j in range(a_low.shape[1]):
                up = b_low[:, j][None, :] - a_high[part, j][:, None]
                down = a_low[part, j][:, None] - b_high[:, j][None, :]
                nearest += np.maximum(np.maximum(up, down), 0.0) ** 2
                farthest += np.maximum(
                    np.abs(b_high[:, j][None, :] - a_low[part, j][:, None]),
                    np.abs(a_high[part, j][:, None] - b_low[:, j][None, :]),
                ) ** 2
            sure = np.sqrt(farthest) <= eps * (1 - 1e-12)
            for i, k in zip(*np.nonzero(sure)):
                forest.join(int(qv[part.start + i]), int(pv[k]))
            unsure = ~sure & (np.sqrt(nearest) <= eps * (1 + 1e-12)) & (qv[part][:, None] < pv[None, :])
            maybe += [(int(qv[part.start + i]), int(pv[k])) for i, k in zip(*np.nonzero(unsure))]
        maybe = [(a, b) for a, b in maybe if forest.find(a) != forest.find(b)]
        moved, roots = forest.edges()
        return pd.DataFrame(
            {
                "a": moved + [a for a, _ in maybe],
                "b": roots + [b for _, b in maybe],
                "sure": [True] * len(moved) + [False] * len(maybe),
            }
        )

    return work


def _touch(eps: float):
    def work(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(queries["vec"]), matrix(points["vec"])
        for part in chunks(len(a), len(b)):
            if (distances(a[part], b) <= eps).any():
                return pd.DataFrame({"pair": [int(queries["cell"].iloc[0])]})
        return pd.DataFrame({"pair": pd.Series([], dtype="int64")})

    return work


def _near_box(vec: Column, low: Column, high: Column, eps: float) -> Column:
    """The point lies within eps of the box."""
    gaps = F.zip_with(F.zip_with(low, vec, lambda l, v: l - v), F.zip_with(vec, high, lambda v, h: v - h), lambda a, b: F.greatest(a, b))
    squares = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.pow(F.greatest(g, F.lit(0.0)), F.lit(2.0)))
    return squares <= F.lit((eps * (1 + 1e-9)) ** 2)


def _boxes(points: DataFrame, width: int, side: float, min_points: int) -> tuple[DataFrame, DataFrame]:
    """Points with the vertex of their box (NULL in a thin one), and the crowded boxes."""
    gridded = points.withColumn("grid", F.transform("vec", lambda v: F.floor(v / F.lit(side))))
    low = F.array(*[F.min(F.col("vec")[i]) for i in range(width)])
    high = F.array(*[F.max(F.col("vec")[i]) for i in range(width)])
    crowded = written(
        gridded.groupBy("grid")
        .agg(
            F.sum("weight").alias("rows"),
            F.count(F.lit(1)).alias("__n"),
            F.min("id").alias("vertex"),
            low.alias("low"),
            high.alias("high"),
        )
        .filter(F.col("rows") >= min_points),
        "boxes",
    )
    placed = lookup_join(gridded, crowded.select("grid", "vertex", "__n"), "grid", n_rows=points.count())
    return placed.drop("grid"), crowded


def _box_edges(crowded: DataFrame, core: DataFrame, eps: float, block: int | None) -> DataFrame:
    """Edges between crowded boxes."""
    centre = F.zip_with("low", "high", lambda a, b: (a + b) / F.lit(2.0))
    boxes = crowded.select(F.col("vertex").alias("id"), centre.alias("vec"), "low", "high")
    spark = crowded.sparkSession
    if boxes.limit(2).count() < 2:
        return spark.createDataFrame([], "a bigint, b bigint")
    cells, placed = Cells.build(boxes, block)
    queries = placed.select("id", "low", "high", cells.reach(placed, F.lit(2.0 * eps)).alias("cells"))
    pairs = written(
        block_join(
            queries, placed.select("id", "low", "high", "cell"), cells.block, _box_pairs(eps),
            "a bigint, b bigint, sure boolean",
        ),
        "pairs",
    )
    edges = pairs.filter("sure").select("a", "b")
    unsure = pairs.filter("not sure").select("a", "b").distinct()
    if unsure.isEmpty():
        return edges
    # Pairs that the certain edges already connect need no look at their points.
    known = written(components(crowded.select(F.col("vertex").alias("id")), edges), "known")
    open_pairs = written(
        unsure.join(known.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a")
        .join(known.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        .filter("ra <> rb")
        .select(F.monotonically_increasing_id().alias("pair"), "a", "b"),
        "open",
    )
    if open_pairs.isEmpty():
        return edges
    shape = crowded.select("vertex", "low", "high")

    def edge_points(mine: str, other: str) -> DataFrame:
        """Points of one box that lie within eps of the other box of a pair."""
        wanted = (
            open_pairs.join(shape.withColumnRenamed("vertex", other), other)
            .groupBy(F.col(mine).alias("vertex"))
            .agg(F.collect_list(F.struct("pair", "low", "high")).alias("facing"))
        )
        sizes = crowded.select("vertex", "__n")
        facing = wanted.join(sizes, "vertex")
        hit = lookup_join(core.select("id", "vec", "vertex"), facing, "vertex").filter("facing is not null")
        each = hit.select("id", "vec", F.explode("facing").alias("f"))
        return each.filter(_near_box(F.col("vec"), F.col("f.low"), F.col("f.high"), eps)).select(
            "id", "vec", F.col("f.pair").alias("cell")
        )

    left = edge_points("a", "b").select("id", "vec", F.array("cell").alias("cells"))
    touching = block_join(
        left, edge_points("b", "a"), cells.block, _touch(eps), "pair bigint", few_cells=False
    ).distinct()
    return edges.unionByName(open_pairs.join(touching, "pair").select("a", "b"))


def dbscan(
    df: DataFrame,
    eps: float = 0.5,
    min_points: int = 5,
    features: str = "features",
    output: str = "prediction",
    block: int | None = None,
) -> DataFrame:
    """Add the cluster of each row, or -1 for noise.

    Clusters are numbered by their smallest core point; a border point goes to the smallest number
    among the clusters it touches.
    """
    points = distinct_vectors(df, features)
    width = len(points.first().vec)
    # Two touching boxes of this side still fit into a ball of diameter eps.
    side = eps / (2.0 * math.sqrt(width)) * (1 - 1e-9)
    with_vertex, crowded = _boxes(points, width, side, min_points)
    cells, placed = Cells.build(with_vertex, block)
    all_points = placed.select("id", "vec", "weight", "cell")

    thin = placed.filter("vertex is null").select("id", "vec", cells.reach(placed, F.lit(eps)).alias("cells"))
    counted = block_join(thin, all_points, cells.block, _count_near(eps), "id bigint, near bigint")
    thin_core = written(
        counted.groupBy("id").agg(F.sum("near").alias("near")).filter(F.col("near") >= min_points).select("id"),
        "core",
    )
    marked = written(
        placed.join(thin_core.withColumn("thin_core", F.lit(True)), "id", "left").withColumn(
            "vertex", F.coalesce("vertex", F.when(F.col("thin_core"), F.col("id")))
        ),
        "marked",
    )
    core = marked.filter("vertex is not null")
    asking = core.filter("thin_core").select("id", "vec", "vertex", cells.reach(core, F.lit(eps)).alias("cells"))
    links = block_join(
        asking, core.select("id", "vec", "vertex", "cell"), cells.block, _link_near(eps), "a bigint, b bigint"
    )
    edges = links.unionByName(_box_edges(crowded, core, eps, block))
    vertices = crowded.select(F.col("vertex").alias("id")).unionByName(thin_core)
    joined = written(components(vertices, edges), "roots")

    # A root stands for all vertices of its cluster; its number is the rank of its smallest point.
    sizes = core.groupBy("vertex").agg(F.count(F.lit(1)).alias("__n"), F.min("vec").alias("first"))
    by_vertex = sizes.join(joined, sizes.vertex == joined.id).select("vertex", "__n", "first", "root")
    numbers = ranked(by_vertex.groupBy("root").agg(F.min("first").alias("first")), "first").select(
        "root", F.col("code").alias("label")
    )
    labels = written(by_vertex.join(numbers, "root").select("vertex", "__n", "label"), "labels")
    labelled = written(lookup_join(marked, labels, "vertex"), "labelled")

    border = labelled.filter("label is null")
    asking = border.select("id", "vec", cells.reach(border, F.lit(eps)).alias("cells"))
    touched = block_join(
        asking,
        labelled.filter("label is not null").select("id", "vec", "label", "cell"),
        cells.block,
        _label_near(eps),
        "id bigint, label bigint",
    )
    adopted = touched.groupBy("id").agg(F.min("label").alias("adopted"))
    answers = labelled.join(adopted, "id", "left").select(
        F.col("vec").alias("__vec"),
        F.col("weight").alias("__n"),
        F.coalesce("label", "adopted", F.lit(NOISE)).cast("int").alias(output),
    )
    return lookup_join(df.withColumn("__vec", vector_array(df, features)), answers, "__vec").drop("__vec")


class DensityClusters:
    """M13 as a model: it labels the rows it is fitted on, so ``transform`` takes those rows."""

    def __init__(self, eps: float = 0.5, min_points: int = 5):
        self.eps, self.min_points = eps, min_points

    def fit(self, df: DataFrame) -> "DensityClusters":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return dbscan(df, self.eps, self.min_points)
