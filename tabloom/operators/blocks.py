"""Exact distance joins over vectors without a cross join.

Points go down a tree of pivots, to the nearest one at each node, until a cell holds a block of them. A query only meets
the cells that the triangle inequality cannot rule out, and a cell meets its queries in blocks of bounded size, so a
crowded cell is more tasks and never one large one. Equal vectors are combined beforehand and carry a weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import col
from ..session import written
from .lookup import lookup_join

# Points of a cell, at least and at most, unless a caller says otherwise.
LEAST_CELL = 256
BLOCK = 1_024
# Children of a node, and the size at which the tree stops growing: two million pivots of two coordinates.
FAN = 64
TREE_BYTES = 96 << 20
# Points that the upper part of the tree is grown from.
SAMPLE = 20_000
_ROOT = -1
_CHUNK_CELLS = 4_000_000
# Cells on a shelf, at most (a bit each), and the bytes of its vectors.
_SHELF_CELLS = 62
_SHELF_BYTES = 16 << 20
# Pairs of a matrix product at a time.
_PRODUCT_CELLS = 1 << 20


def vector_array(df: DataFrame, features: str) -> Column:
    """The features as ARRAY<DOUBLE>, with one zero."""
    c = col(features)
    if df.schema[features].dataType.typeName() != "array":
        c = vector_to_array(c)
    return F.transform(c.cast("array<double>"), lambda v: v + F.lit(0.0))


def distinct_vectors(df: DataFrame, features: str = "features", label: str | None = None) -> DataFrame:
    """(id, vec, weight[, labels, counts]): each distinct vector once, kept in the shared folder.

    With ``label`` the classes of its copies come along as parallel arrays, one entry per class.
    """
    vec = vector_array(df, features).alias("vec")
    if label is None:
        grouped = df.select(vec).groupBy("vec").agg(F.count(F.lit(1)).alias("weight"))
    else:
        by_class = df.select(vec, col(label).cast("double").alias("y")).groupBy("vec", "y").agg(
            F.count(F.lit(1)).alias("n")
        )
        # A group here has one row per class, not per copy.
        grouped = by_class.groupBy("vec").agg(
            F.sum("n").alias("weight"), F.array_sort(F.collect_list(F.struct("y", "n"))).alias("classes")
        ).select(
            "vec",
            "weight",
            F.col("classes.y").alias("labels"),
            F.transform("classes.n", lambda v: v.cast("double")).alias("counts"),
        )
    return written(grouped.select(F.monotonically_increasing_id().alias("id"), "*"), "vectors")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two blocks, summed over coordinates as they are."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j][:, None] - b[:, j][None, :]) ** 2
    return np.sqrt(total)


def matrix(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy()) if len(series) else np.zeros((0, 1))


def chunks(n_rows: int, n_columns: int):
    """Slices of rows whose distance block stays small."""
    step = max(1, _CHUNK_CELLS // max(n_columns, 1))
    return (slice(i, min(i + step, n_rows)) for i in range(0, n_rows, step))


class NearPairs:
    """The pairs of two blocks within a bound. A matrix product in single precision rules pairs out, by no more than its
    rounding allows; the others are measured as :func:`distances` does."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.width = a, b, a.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            centre = b.mean(axis=0)
            x, y = a - centre, b - centre
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            self.scale = float(np.sqrt(max(xx.max(), yy.max())))
        # Blocks with values that are no numbers, too large or all the same are measured whole.
        self.ruled = bool(np.isfinite(self.scale)) and self.scale > 1e-100
        if not self.ruled:
            return
        self.left = np.empty((len(a), self.width + 2), np.float32)
        self.left[:, :-2], self.left[:, -1] = -2.0 * (x / self.scale), 1.0
        self.right = np.empty((len(b), self.width + 2), np.float32)
        self.right[:, :-2], self.right[:, -2], self.right[:, -1] = y / self.scale, 1.0, yy / self.scale**2
        self.xx = xx / self.scale**2
        # Scaled vectors are at most 1 long, so the terms of a product add up to less than 10.
        self.slack = 16 * (self.width + 8) * 2.0**-24

    def within(self, rows: np.ndarray, columns: slice, bound: np.ndarray):
        """(row, column, distance) of the pairs of these rows and columns, some rows at a time; ``bound`` is by row and
        may shrink meanwhile."""
        right = self.b[columns] if not self.ruled else self.right[columns]
        step = max(1, _PRODUCT_CELLS // max(len(right), 1))
        for start in range(0, len(rows), step):
            mine = rows[start : start + step]
            limit = bound[mine]
            if self.ruled:
                left = self.left[mine]
                left[:, -2] = self.xx[mine] - np.minimum((limit / self.scale) ** 2, 5.0) - self.slack
                r, c = np.divmod(np.flatnonzero(left @ right.T <= 0), len(right))
                far = np.zeros(len(r))
                for j in range(self.width):
                    far += (self.a[mine[r], j] - self.b[columns.start + c, j]) ** 2
                far = np.sqrt(far)
                near = far <= limit[r]
                r, c, far = r[near], c[near], far[near]
            else:
                d = distances(self.a[mine], right)
                r, c = np.nonzero(d <= limit[:, None])
                far = d[r, c]
            yield mine[r], columns.start + c, far


@dataclass
class Cells:
    """A tree of pivots: the points of a node lie nearest to its pivot among its siblings; nodes without children are cells.

    A node that holds more points than two blocks is split by pivots drawn among them, until none does, so the size
    of a cell does not grow with the table. The tree is held by every
    task; it stops growing at ``TREE_BYTES``, beyond which cells are larger and searched block by block.
    """

    pivots: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    block: int

    def __post_init__(self):
        order = np.argsort(self.parent, kind="stable")
        owners, first = np.unique(self.parent[order], return_index=True)
        self.children = dict(zip(owners.tolist(), np.split(order, first[1:])))
        self.gaps = {node: distances(self.pivots[kids], self.pivots[kids]) for node, kids in self.children.items()}

    @property
    def single(self) -> bool:
        return len(self.pivots) == 1

    @staticmethod
    def build(points: DataFrame, block: int | None = None, seed: int = 42) -> tuple["Cells", DataFrame]:
        """Grow the tree over (id, vec, ...) and add ``cell`` to each point.

        The upper part is grown from a bounded sample and all points placed in one pass; cells that are still too
        large are split step by step.
        """
        n = points.count()
        cores = points.sparkSession.sparkContext.defaultParallelism
        size = block or int(min(max(math.ceil(n / (2 * cores)), LEAST_CELL), BLOCK))
        if not n:
            return Cells(np.zeros((1, 1)), np.array([-np.inf]), np.array([_ROOT]), size), points.withColumn("cell", F.lit(0))
        tree = _sampled(points, n, size, seed)
        told = tree._home(points)
        placed, found = _written(points, told, points.columns, 0)
        pivots, parent = list(tree.pivots), tree.parent.tolist()
        radius = [found[i].far if i in found else -np.inf for i in range(len(pivots))]
        # Points that are all equal cannot be parted.
        crowded, turn = {i: r.n for i, r in found.items() if r.n > 2 * size and r.far > 0}, 1
        while crowded and len(pivots) * (len(pivots[0]) + 4) * 8 <= TREE_BYTES:
            # Nodes of which no second pivot was drawn are tried again.
            drawn = _drawn(placed, crowded, size, seed + turn)
            turn += 1
            if not drawn:
                continue
            first = len(pivots)
            for node, vectors in drawn.items():
                pivots += vectors
                parent += [node] * len(vectors)
            step = Cells(np.array(pivots[first:], float), np.zeros(len(pivots) - first), np.array(parent[first:]), size)
            placed, found = _written(placed, step._nearest(placed, first), points.columns, first)
            radius += [found[i].far if i in found else -np.inf for i in range(first, len(pivots))]
            crowded = {i: c for i, c in crowded.items() if i not in drawn}
            crowded |= {i: r.n for i, r in found.items() if r.n > 2 * size and r.far > 0}
        pivots, radius, parent = np.array(pivots, float), np.array(radius), np.array(parent)
        # What lies below a node is at most as far as its children are and reach; children come behind their parents.
        for i in range(len(parent) - 1, -1, -1):
            if parent[i] != _ROOT and parent[i] in tree.children:
                up = parent[i]
                radius[up] = max(radius[up], (distances(pivots[up : up + 1], pivots[i : i + 1])[0, 0] + radius[i]) * (1 + 1e-12))
        return Cells(pivots, radius, parent, size), placed

    def _nearest(self, placed: DataFrame, first: int) -> Column:
        """One step down: the child (numbered from ``first``) and the distance, for points of a node that is split."""
        shared = placed.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("cell int, far double")
        def nearest(vec: pd.Series, cell: pd.Series) -> pd.DataFrame:
            tree = shared.value
            points, at = matrix(vec), cell.to_numpy()
            to, far = at.copy(), np.full(len(at), np.nan)
            for node, kids in tree.children.items():
                here = np.flatnonzero(at == node)
                for part in chunks(len(here), len(kids)):
                    d = distances(points[here[part]], tree.pivots[kids])
                    to[here[part]], far[here[part]] = kids[d.argmin(axis=1)] + first, d.min(axis=1)
            return pd.DataFrame({"cell": to, "far": far})

        return nearest(F.col("vec"), F.col("cell"))

    def _home(self, df: DataFrame) -> Column:
        """(cell, far): the cell that a point of any table falls into, and how far it is from its pivot."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("cell int, far double")
        def home(vec: pd.Series) -> pd.DataFrame:
            tree, points = shared.value, matrix(vec)
            to, far = np.zeros(len(points), np.int64), np.zeros(len(points))
            todo = [(_ROOT, np.arange(len(points)))] if len(points) else []
            while todo:
                node, rows = todo.pop()
                kids = tree.children[node]
                for part in chunks(len(rows), len(kids)):
                    d = distances(points[rows[part]], tree.pivots[kids])
                    to[rows[part]], far[rows[part]] = kids[d.argmin(axis=1)], d.min(axis=1)
                near = to[rows]
                todo += [(int(kid), rows[near == kid]) for kid in np.unique(near) if int(kid) in tree.children]
            return pd.DataFrame({"cell": to, "far": far})

        return home(F.col("vec"))

    def home(self, df: DataFrame) -> Column:
        """The cell that a point of any table falls into."""
        return self._home(df)["cell"]

    def _open(self, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that may hold a point within ``bound`` of a row, by row."""
        rows_out, cells_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(_ROOT, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            radius, gaps = self.radius[kids], self.gaps[node]
            for part in chunks(len(rows), len(kids)):
                mine = rows[part]
                far = distances(points[mine], self.pivots[kids])
                nearest = far.min(axis=1)
                # Rounding must never rule a cell out.
                slack = 1e-9 * (1.0 + far)
                limit = bound[mine][:, None]
                passed = (far - radius[None, :] - slack <= limit) & (radius[None, :] >= 0)
                gap = gaps[far.argmin(axis=1)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (far**2 - nearest[:, None] ** 2) / (2.0 * gap)
                plane[gap == 0] = -np.inf
                passed &= plane - slack <= limit
                for j, kid in enumerate(kids.tolist()):
                    hit = mine[passed[:, j]]
                    if not len(hit):
                        continue
                    if kid in self.children:
                        todo.append((kid, hit))
                    else:
                        rows_out.append(hit)
                        cells_out.append(np.full(len(hit), kid))
        found, cells = np.concatenate(rows_out), np.concatenate(cells_out)
        order = np.lexsort((cells, found))
        return found[order], cells[order]

    def reach(self, df: DataFrame, limit: Column, home: Column | None = None) -> Column:
        """The cells that may hold a point within ``limit`` of a query, its home cell left out."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def reach(vec: pd.Series, limit: pd.Series, home: pd.Series) -> pd.Series:
            points = matrix(vec)
            rows, cells = shared.value._open(points, limit.to_numpy(dtype=float)) if len(points) else (np.zeros(0, int), np.zeros(0, int))
            other = cells != home.to_numpy()[rows]
            rows, cells = rows[other], cells[other]
            ends = np.searchsorted(rows, np.arange(len(points) + 1))
            return pd.Series([cells[a:b].tolist() for a, b in zip(ends, ends[1:])], dtype=object)

        return reach(F.col("vec"), limit.cast("double"), (F.lit(-1) if home is None else home).cast("int"))

    def places(self) -> np.ndarray:
        """The place of each cell among all cells, those of one node side by side; -1 for nodes with children."""
        place, todo, n = np.full(len(self.parent), -1, np.int64), [_ROOT], 0
        while todo:
            node = todo.pop()
            if node in self.children:
                todo += self.children[node][::-1].tolist()
            else:
                place[node], n = n, n + 1
        return place

    def shelves(self, n_queries: int, n_points: int, cores: int) -> tuple[int, int]:
        """(cells on a shelf, points of a block) for a search that opens most cells: blocks are as large as memory and
        the cores allow, since each query is sent to each block once."""
        most = max(_SHELF_BYTES // (8 * self.pivots.shape[1]), 2 * self.block)
        points = int(min(max(math.isqrt(n_queries * n_points // (4 * cores)), 2 * self.block), most))
        cells = int((self.places() >= 0).sum())
        return min(max(points * cells // (2 * max(n_points, 1)), 1), _SHELF_CELLS), points

    def shelved(self, placed: DataFrame, width: int) -> DataFrame:
        """The points with the shelf of their cell as ``cell`` and its place on it as ``place``."""
        shared = placed.sparkSession.sparkContext.broadcast(self.places())

        @F.pandas_udf("int")
        def place(cell: pd.Series) -> pd.Series:
            return pd.Series(shared.value[cell.to_numpy()])

        held = placed.withColumn("__place", place("cell"))
        return held.withColumn("cell", F.floor(F.col("__place") / width).cast("int")).withColumn("place", F.col("__place") % width).drop("__place")

    def reach_shelves(self, df: DataFrame, limit: Column, home: Column, width: int) -> Column:
        """:meth:`reach` by shelves of ``width`` cells: (cell, open) of each shelf, with a bit in ``open`` for each cell."""
        shared = df.sparkSession.sparkContext.broadcast((self, self.places()))

        @F.pandas_udf("cell array<int>, open array<bigint>")
        def reach(vec: pd.Series, limit: pd.Series, home: pd.Series) -> pd.DataFrame:
            tree, places = shared.value
            points = matrix(vec)
            rows, cells = tree._open(points, limit.to_numpy(dtype=float)) if len(points) else (np.zeros(0, int), np.zeros(0, int))
            other = cells != home.to_numpy()[rows]
            rows, place = rows[other], places[cells[other]]
            order = np.lexsort((place, rows))
            rows, shelf, bit = rows[order], place[order] // width, np.int64(1) << place[order] % width
            first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (shelf[1:] != shelf[:-1]))) if len(rows) else np.zeros(0, int)
            shelf, bits = shelf[first].astype(np.int32), np.bitwise_or.reduceat(bit, first) if len(first) else bit
            ends = np.searchsorted(rows[first], np.arange(len(points) + 1))
            cut = lambda x: pd.Series([x[a:b] for a, b in zip(ends, ends[1:])], dtype=object)
            return pd.DataFrame({"cell": cut(shelf), "open": cut(bits)})

        found = reach(F.col("vec"), limit.cast("double"), home.cast("int"))
        return F.arrays_zip(found["cell"].alias("cell"), found["open"].alias("open"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, int(self.parent[i]), float(self.radius[i]), self.pivots[i].tolist(), self.block) for i in range(len(self.pivots))]
        spark.createDataFrame(rows, "node int, parent int, radius double, pivot array<double>, block int").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Cells":
        rows = spark.read.parquet(path).orderBy("node").collect()
        return Cells(np.array([r.pivot for r in rows]), np.array([r.radius for r in rows]), np.array([r.parent for r in rows]), rows[0].block)


def _written(points: DataFrame, told: Column, names: list[str], first: int) -> tuple[DataFrame, dict[int, Any]]:
    """The points with their cells, and of the cells numbered from ``first`` the count and the farthest point."""
    kept = [c for c in names if c != "cell"]
    held = points.withColumn("__near", told).select(*kept, F.col("__near.cell").alias("cell"), F.col("__near.far").alias("far"))
    placed = written(held, "cells")
    sizes = placed.filter(F.col("cell") >= first).groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n"))
    return placed.drop("far"), {r["cell"]: r for r in sizes.collect()}


def _place(seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _sampled(points: DataFrame, n: int, size: int, seed: int) -> Cells:
    """The tree of a sample of ``SAMPLE`` points, as deep as its share of a block, of eight points or more, allows."""
    some = points.select("vec", _place(seed).alias("place")).filter(F.col("place") < min(1.0, SAMPLE / n + 1e-12))
    rows = some.orderBy("place").limit(SAMPLE).select("vec").collect() or points.select("vec").limit(1).collect()
    x = np.array([r.vec for r in rows], float)
    quota = max(size * len(x) / n, 8.0) if len(x) < n else float(size)
    rng = np.random.default_rng(seed)
    pivots, parent, todo = [], [], [(_ROOT, np.arange(len(x)))]
    while todo:
        node, mine = todo.pop(0)
        kids = rng.choice(mine, min(FAN, max(math.ceil(len(mine) / quota), 1 if node == _ROOT else 2)), replace=False)
        first = len(pivots)
        pivots += list(x[kids])
        parent += [node] * len(kids)
        near = np.concatenate([distances(x[mine[part]], x[kids]).argmin(axis=1) for part in chunks(len(mine), len(kids))])
        for j in range(len(kids)):
            below = mine[near == j]
            if len(below) > 2 * quota and (x[below] != x[kids[j]]).any():
                todo.append((first + j, below))
    return Cells(np.array(pivots), np.zeros(len(pivots)), np.array(parent), size)


def _drawn(placed: DataFrame, crowded: dict[int, int], size: int, seed: int) -> dict[int, list[list[float]]]:
    """Pivots for the nodes that hold too many points: at most ``FAN`` each, and at least two."""
    wanted = {node: min(FAN, max(math.ceil(n / size), 2)) for node, n in crowded.items()}
    rates = placed.sparkSession.createDataFrame(
        [(node, min(1.0, (2.0 * wanted[node] + 8) / n)) for node, n in crowded.items()], "cell int, rate double"
    )
    some = placed.select("cell", "vec", _place(seed).alias("place")).join(F.broadcast(rates), "cell").filter("place < rate")
    by_node: dict[int, list[list[float]]] = {}
    # About twice as many rows as pivots are wanted.
    for r in some.orderBy("cell", "place").select("cell", "vec").collect():
        mine = by_node.setdefault(r["cell"], [])
        if len(mine) < wanted[r["cell"]]:
            mine.append(list(r.vec))
    return {node: v for node, v in by_node.items() if len(v) > 1}


def pairs_compared(queries: DataFrame, points: DataFrame) -> int:
    """How many pairs a :func:`block_join` of these frames looks at."""
    asked = queries.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
    held = points.groupBy("cell").agg(F.count(F.lit(1)).alias("p"))
    return int(asked.join(held, "cell").agg(F.coalesce(F.sum(F.col("q") * F.col("p")), F.lit(0))).first()[0])


def block_join(
    queries: DataFrame,
    points: DataFrame,
    block: int,
    work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    few_cells: bool = True,
) -> DataFrame:
    """Run ``work(query block, point block)`` for every block pair that shares a cell.

    ``queries`` has (id, …, cells ARRAY), ``points`` has (id, …, cell). The array may hold structs of a ``cell`` and more
    columns. Both blocks hold about ``block`` rows at most, however many rows a cell has. ``few_cells`` says that the cells are pivots, whose
    number is bounded; otherwise their sizes are looked up by a balanced join.
    """
    spread = queries.select(*[c for c in queries.columns if c != "cells"], F.explode("cells").alias("cell"))
    if isinstance(spread.schema["cell"].dataType, T.StructType):
        spread = spread.select(*spread.columns[:-1], "cell.*")
    p_sizes = points.select(col("cell").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("__p"))
    q_sizes = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("__q"))
    sizes = p_sizes.join(q_sizes, "cell").select(
        "cell",
        (F.col("__p") + F.col("__q")).alias("__n"),
        F.ceil(F.col("__p") / F.lit(block)).cast("int").alias("p_blocks"),
        F.ceil(F.col("__q") / F.lit(block)).cast("int").alias("q_blocks"),
    )

    def sized(side: DataFrame) -> DataFrame:
        if few_cells:
            return side.join(F.broadcast(sizes.drop("__n")), "cell")
        return lookup_join(side, sizes, "cell").filter(F.col("p_blocks").isNotNull())

    # Both sides may stem from one frame; fresh names keep them apart.
    points = points.select(*[col(c).alias(c) for c in points.columns])
    left = (
        sized(spread)
        .withColumn("qb", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int"))
        .withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("p_blocks") - 1)))
        .drop("p_blocks", "q_blocks")
    )
    right = (
        sized(points)
        .withColumn("pb", F.pmod(F.xxhash64("id"), F.col("p_blocks")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .drop("p_blocks", "q_blocks")
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame(columns=names)
        return work(a, b)

    keys = ["cell", "pb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
