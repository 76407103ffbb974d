"""Gradient boosting on histograms (M3, M9, M10): the trees of all classes of a round grow together.

Features are binned once, and rows whose features share all bins become one with their number and the sums of their
labels: they have one margin for good, so their gradients add up exactly. One pass over these rows per tree level sums
gradients and Hessians by (class, node, feature, bin): a task adds up its rows, the sums of all tasks meet by node and feature, and only the best split of each node
comes to the driver. Leaves are split best first, bounded in number, depth or both; a level is a pass whatever the
number of classes. Margins of the rows are written anew every ``REWRITE`` rounds, and later trees are added while
reading, so that neither lineage nor work per pass grows with the rounds.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, spread, tasks_for, written
from .blocks import matrix, vector_array

MAX_BINS = 255
REWRITE = 10
# Leaves of a level by (node, feature) that one task of the second step sums.
_TASK_SUMS = 2_000


@dataclass
class Node:
    """A node of a tree; ``split`` is (gain, feature, bin) of its best split, where it has one."""

    depth: int
    g: float = 0.0
    h: float = 0.0
    n: float = 0.0
    split: tuple[float, int, int] | None = None
    below: tuple[float, float, float] | None = None  # sums of the rows that go left
    children: tuple["Node", "Node"] | None = None
    place: int = -1


def best_first(root: Node, max_leaves: int) -> list[Node]:
    """The nodes that are split, in the order of their gains among the leaves there are at the time."""
    chosen: list[Node] = []
    open_leaves: list[tuple[float, int, Node]] = []

    def offer(node: Node) -> None:
        if node.split is not None:
            heapq.heappush(open_leaves, (-node.split[0], len(chosen) * 2 + len(open_leaves), node))

    offer(root)
    while open_leaves and len(chosen) + 1 < max_leaves:
        node = heapq.heappop(open_leaves)[2]
        chosen.append(node)
        for child in node.children or ():
            offer(child)
    return chosen


@dataclass
class Tree:
    """Parallel arrays; leaves have feature -1. Rows with x <= threshold (bin <= bins) go left."""

    feature: np.ndarray
    bins: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def land(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``, compared with ``cuts`` (``bins`` or ``threshold``)."""
        at = np.zeros(len(x), np.int64)
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        inner = self.feature >= 0
        # Leaves lead to themselves; NaN is not at most anything: it goes right, as its bin is the last.
        here = np.arange(len(inner))
        feature = np.maximum(self.feature, 0)
        below = np.stack([np.where(inner, self.right, here), np.where(inner, self.left, here)], axis=1).ravel()
        for _ in range(self.depth):
            at = below[2 * at + (flat[first + feature[at]] <= cuts[at])]
        return at

    @property
    def depth(self) -> int:
        """Splits on the longest way to a leaf; children come behind their parents."""
        level = np.zeros(len(self.feature), np.int64)
        for i in np.flatnonzero(self.feature >= 0):
            level[[self.left[i], self.right[i]]] = level[i] + 1
        return int(level.max())

    def to_json(self) -> dict:
        return {k: v.tolist() for k, v in self.__dict__.items()}

    @staticmethod
    def from_json(state: dict) -> "Tree":
        whole = ("feature", "bins", "left", "right")
        return Tree(**{k: np.array(v, np.int64 if k in whole else float) for k, v in state.items()})


def _tree(root: Node, chosen: list[Node], edges: list[np.ndarray], leaf: Callable[[Node], float]) -> Tree:
    split = {id(n) for n in chosen}
    nodes, todo = [], [root]
    while todo:
        node = todo.pop(0)
        node.place = len(nodes)
        nodes.append(node)
        if id(node) in split:
            todo += node.children
    inner = [id(n) in split for n in nodes]
    pick = lambda fn, other, kind=float: np.array([fn(n) if s else other for n, s in zip(nodes, inner)], kind)
    return Tree(
        pick(lambda n: n.split[1], -1, np.int64), pick(lambda n: n.split[2], 0, np.int64),
        pick(lambda n: edges[n.split[1]][n.split[2]], 0.0),
        pick(lambda n: n.children[0].place, 0, np.int64), pick(lambda n: n.children[1].place, 0, np.int64),
        np.array([leaf(n) for n in nodes]), np.array([n.n for n in nodes]), pick(lambda n: n.split[0], 0.0),
    )


def bin_edges(df: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: quantiles, so each value that is frequent enough has its own."""
    shares = [i / bins for i in range(1, bins)]
    cells = [F.percentile_approx(F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]), shares, 20 * bins).alias(f"e{j}") for j in range(width)]
    found: list[np.ndarray] = []
    # A hundred features at a time keep the generated code small.
    for at in range(0, width, 100):
        row = df.agg(*cells[at : at + 100]).first()
        found += [np.unique(np.array(e if e is not None else [0.0], float)) for e in row]
    return found


def _cells(bins: np.ndarray) -> pa.Array:
    """Each row of a matrix of bytes as one binary value."""
    n, width = bins.shape
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(bins))])


def _binned(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([_cells(bins), batch.column("label")], names=["bins", "label"])

    return run


# A block of groups as matrices of bytes: ``n`` rows with equal bins each; ``labels`` is the sum of their labels, or for
# several classes the rows of each.
_ROWS = "size int, bins binary, n binary, labels binary, margin binary"
# Groups of a task of a pass, at most.
_PASS_ROWS = 2_000_000


def _written_blocks(blocks: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], kind) for i, kind in enumerate(kinds)], names=["size", "bins", "n", "labels", "margin"])


def _packed(base: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            bins = b"".join(batch.column("bins").to_pylist())
            n = batch.column("n").to_numpy(zero_copy_only=False)
            labels = batch.column("labels").flatten().to_numpy(zero_copy_only=False)
            yield _written_blocks([(size, bins, n.tobytes(), labels.tobytes(), np.tile(np.array(base), size).tobytes())])

    return run


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, n, labels, margin) of each block."""
    for size, bins, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
        n, labels, margin = (np.frombuffer(v, float).reshape(size, -1) for v in numbers)
        yield np.frombuffer(bins, np.uint8).reshape(size, -1), n[:, 0], labels, margin


def _added(margin: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    margin = margin.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            margin[:, k] += tree.value[tree.land(bins, tree.bins)]
    return margin


def slopes(margin: np.ndarray, n: np.ndarray, labels: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each margin, summed over the ``n`` rows of each group."""
    n = n[:, None]
    if loss == "squared":
        return n * margin - labels, n * np.ones_like(margin)
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        return n * p - labels, n * (p * (1 - p))
    p = np.exp(margin - margin.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return n * p - labels, n * (p * (1 - p))


def _rewritten(rounds: list[list[Tree]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bins, n, labels = (batch.column(c).to_pylist() for c in ("size", "bins", "n", "labels"))
            margins = (_added(margin, x, rounds).tobytes() for x, _, _, margin in _read(batch))
            for block in zip(sizes, bins, n, labels, margins):
                yield _written_blocks([block])

    return run


def _sums(rounds: list[list[Tree]], growing: list[Tree], slots: list[dict[int, int]], n_slots: int, loss: str, width: int, n_bins: int):
    """One row for each open node and feature: sums of (gradient, Hessian, rows) by bin over the groups of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width, n_slots * n_bins))
        for bins, n, labels, margin in (block for batch in batches for block in _read(batch)):
            g, h = slopes(_added(margin, bins, rounds), n, labels, loss)
            for k, (tree, open_nodes) in enumerate(zip(growing, slots)):
                if not open_nodes:
                    continue
                slot_of = np.full(len(tree.feature), -1)
                slot_of[list(open_nodes)] = list(open_nodes.values())
                slot = slot_of[tree.land(bins, tree.bins)]
                here = np.flatnonzero(slot >= 0)
                first, mine = slot[here] * n_bins, bins[here]
                # For the squared loss the Hessians are the rows.
                weights = {0: g[here, k], 2: n[here]} | ({1: h[here, k]} if loss != "squared" else {})
                for j in range(width):
                    cell = first + mine[:, j]
                    for c, weight in weights.items():
                        total[c, j] += np.bincount(cell, weight, n_slots * n_bins)
        if loss == "squared":
            total[1] = total[2]
        by_key = np.ascontiguousarray(total.reshape(3, width, n_slots, n_bins).transpose(2, 1, 3, 0))
        some = np.argwhere(by_key[..., 2].any(axis=2))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some[:, 0].astype(np.int32)), pa.array(some[:, 1].astype(np.int32)),
                pa.array([by_key[s, f].tobytes() for s, f in some], pa.binary()),
            ],
            names=["slot", "feature", "sums"],
        )

    return run


_SPLITS = "slot int, gain double, feature int, bin int, g double, h double, n double, left_g double, left_h double, left_n double"


def split_gains(sums: np.ndarray, l2: float, least_h: float, least_n: float) -> tuple[np.ndarray, np.ndarray]:
    """Gains of a cut behind each bin, and the sums up to it; -inf where a side is too small."""
    below = np.cumsum(sums, axis=0)
    g, h, n = below[-1]
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = below[:, 0] ** 2 / (below[:, 1] + l2) + above[:, 0] ** 2 / (above[:, 1] + l2) - g**2 / (h + l2)
    fits = (below[:, 1] >= least_h) & (above[:, 1] >= least_h) & (below[:, 2] >= least_n) & (above[:, 2] >= least_n)
    return np.where(fits, gain, -np.inf), below


def _tops(rows: Iterable[tuple]) -> dict[int, tuple]:
    """The row with the greatest gain of each slot; of equal ones that of the first feature."""
    tops: dict[int, tuple] = {}
    for r in rows:
        if r[0] not in tops or (r[1], -r[2]) > (tops[r[0]][1], -tops[r[0]][2]):
            tops[r[0]] = r
    return tops


def _best(n_bins: int, l2: float, least_h: float, least_n: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for slot, feature, sums in zip(*(batch.column(c).to_pylist() for c in ("slot", "feature", "sums"))):
                part = np.frombuffer(sums, float)
                mine = total.get((slot, feature))
                total[slot, feature] = part.copy() if mine is None else mine + part
        rows = []
        for (slot, feature), flat in total.items():
            gain, below = split_gains(flat.reshape(n_bins, 3), l2, least_h, least_n)
            at = int(gain.argmax())
            rows.append((slot, float(gain[at]), feature, at, *map(float, below[-1]), *map(float, below[at])))
        rows = list(_tops(rows).values())
        names = [c.split()[0] for c in _SPLITS.split(", ")]
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32()] + [pa.float64()] * 6
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return run


@dataclass
class BoostedModel:
    """Adds ``prediction``; for classes also ``probability``, an array."""

    loss: str
    base: list[float]
    rounds: list[list[Tree]]
    n_features: int
    passes: int = field(default=0)

    @property
    def featureImportances(self):  # noqa: N802
        from pyspark.ml.linalg import Vectors

        gains = np.zeros(self.n_features)
        for tree in (t for trees in self.rounds for t in trees):
            np.add.at(gains, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return Vectors.dense(gains / gains.sum() if gains.sum() > 0 else gains)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.tile(np.array(self.base), (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                total[:, k] += tree.value[tree.land(x, tree.threshold)]
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        model = self
        shared = df.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("array<double>")
        def margin(vec: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.margins(matrix(vec)))) if len(vec) else pd.Series([], dtype=object)

        scored = df.withColumn("__margin", margin(vector_array(df, "features")))
        m = F.col("__margin")
        if self.loss == "squared":
            return scored.withColumn("prediction", m[0]).drop("__margin")
        if self.loss == "logistic":
            p = 1 / (1 + F.exp(-m[0]))
            return scored.withColumn("probability", F.array(1 - p, p)).withColumn("prediction", (m[0] > 0).cast("double")).drop("__margin")
        top = F.array_max(m)
        raised = F.transform(m, lambda v: F.exp(v - top))
        scored = scored.withColumn("__raised", raised)
        share = F.transform("__raised", lambda v: v / F.aggregate("__raised", F.lit(0.0), lambda a, b: a + b))
        best = (F.array_position(m, top) - 1).cast("double")
        return scored.withColumn("probability", share).withColumn("prediction", best).drop("__margin", "__raised")

    def save(self, path: str, spark: SparkSession) -> None:
        state = {"loss": self.loss, "base": self.base, "n_features": self.n_features}
        rows = [(-1, json.dumps(state))] + [(i, json.dumps([t.to_json() for t in trees])) for i, trees in enumerate(self.rounds)]
        spark.createDataFrame(rows, "round int, state string").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedModel":
        rows = spark.read.parquet(path).orderBy("round").collect()
        state = json.loads(rows[0].state)
        rounds = [[Tree.from_json(t) for t in json.loads(r.state)] for r in rows[1:]]
        return BoostedModel(state["loss"], state["base"], rounds, state["n_features"])


@dataclass
class BoostedTrees:
    """Boosting by ``rounds`` of one tree for numbers and two classes, and of one tree per class beyond.

    ``max_leaves`` splits the leaf with the greatest gain first until there are that many, ``max_depth`` bounds the
    depth; either may be None. A split must gain something and leave each side a Hessian of ``least_hessian``; leaves
    are the Newton step with the penalty ``l2`` times ``step``. Labels of classes are 0, 1, … as doubles. Rows without
    a label are left out; NaN goes right. ``tol`` ends the boosting once no tree of a round has a split.
    """

    rounds: int = 200
    step: float = 0.1
    max_depth: int | None = 6
    max_leaves: int | None = None
    n_classes: int = 0
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    bins: int = 64

    def _loss(self) -> tuple[str, int]:
        return ("squared", 1) if self.n_classes == 0 else ("logistic", 1) if self.n_classes <= 2 else ("softmax", self.n_classes)

    def prepared(self, df: DataFrame) -> tuple[DataFrame, list[np.ndarray], list[float]]:
        """Blocks of the binned rows, combined and with their first margins, the edges of the bins, and those margins."""
        if not 2 <= self.bins <= MAX_BINS:
            raise ValueError(f"bins: 2 to {MAX_BINS}")
        lean = df.select(vector_array(df, "features").alias("x"), F.col("label").cast("double").alias("label")).filter("label is not null")
        loss, k = self._loss()
        head = lean.agg(F.max(F.size("x")).alias("width"), F.avg("label").alias("mean"), F.count(F.lit(1)).alias("n"),
                        *[F.count_if(F.col("label") == i).alias(f"n{i}") for i in range(k if loss == "softmax" else 0)]).first()
        if not head.n:
            raise ValueError("no rows with a label")
        if loss == "squared":
            base = [float(head["mean"])]
        elif loss == "logistic":
            share = min(max(float(head["mean"]), 1e-6), 1 - 1e-6)
            base = [float(np.log(share / (1 - share)))]
        else:
            base = [float(np.log(max(head[f"n{i}"], 1e-6) / head.n)) for i in range(k)]
        edges = bin_edges(lean, head.width, self.bins)
        y = F.col("label")
        labels = [F.count_if(y == i).cast("double") for i in range(k)] if loss == "softmax" else [F.sum("label")]
        # Combined where they are read, then by their bins.
        groups = lean.mapInArrow(_binned(edges), "bins binary, label double").groupBy("bins").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.array(*labels).alias("labels")
        )
        return written(groups.mapInArrow(_packed(base), _ROWS), "binned"), edges, base

    def fit(self, df: DataFrame) -> BoostedModel:
        rows, edges, base = self.prepared(df)
        loss, k = self._loss()
        model = BoostedModel(loss, base, [], len(edges))
        # Few groups stay in one task, whose sums need no shuffle; many go to all cores.
        tasks = tasks_for(df.sparkSession, rows.agg(F.sum("size")).first()[0], _PASS_ROWS)
        table = (spread(rows, tasks) if tasks > 1 else rows.coalesce(1)).persist(StorageLevel.MEMORY_AND_DISK)
        fresh: list[list[Tree]] = []
        try:
            for _ in range(self.rounds):
                trees, passes = self.grow(table, fresh, edges, k)
                model.passes += passes
                if all(len(t.feature) == 1 for t in trees):
                    break
                model.rounds.append(trees)
                fresh.append(trees)
                if len(fresh) == REWRITE:
                    anew = written(table.mapInArrow(_rewritten(fresh), _ROWS), "margins")
                    table.unpersist()
                    discard(rows)
                    rows, fresh = anew, []
                    enough = rows.rdd.getNumPartitions() >= tasks
                    table = (rows.coalesce(1) if tasks == 1 else rows if enough else spread(rows, tasks)).persist(StorageLevel.MEMORY_AND_DISK)
        finally:
            table.unpersist()
            discard(rows)
        return model

    def grow(self, table: DataFrame, fresh: list[list[Tree]], edges: list[np.ndarray], k: int) -> tuple[list[Tree], int]:
        """The trees of a round, one per class, and the passes over the rows that they took."""
        roots = [Node(0) for _ in range(k)]
        leaf = lambda n: -self.step * n.g / (n.h + self.l2) if n.n else 0.0
        leaves = self.max_leaves or 1 << 30
        open_nodes = [[root] for root in roots]
        passes = 0
        while any(open_nodes):
            self._search(table, fresh, roots, open_nodes, edges)
            passes += 1
            open_nodes = []
            for root in roots:
                # Nodes that are split by what is known so far; an unknown child can only take the place of a later one.
                opened = []
                for node in best_first(root, leaves):
                    if node.children is None:
                        g, h, n = node.below
                        node.children = (Node(node.depth + 1, g, h, n), Node(node.depth + 1, node.g - g, node.h - h, node.n - n))
                        if self.max_depth is None or node.depth + 1 < self.max_depth:
                            opened += node.children
                open_nodes.append(opened)
        return [_tree(root, best_first(root, leaves), edges, leaf) for root in roots], passes

    def _search(self, table: DataFrame, fresh: list[list[Tree]], roots: list[Node], open_nodes: list[list[Node]], edges: list[np.ndarray]) -> None:
        """One pass: the best split of every open node of all trees."""
        growing, slots, by_slot = [], [], []
        for root, mine in zip(roots, open_nodes):
            known, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.children is not None:
                    known.append(node)
                    todo += node.children
            growing.append(_tree(root, known, edges, lambda n: 0.0))
            slots.append({node.place: len(by_slot) + i for i, node in enumerate(mine)})
            by_slot += mine
        width, n_bins = len(edges), max(len(e) for e in edges) + 1
        add = _sums(fresh, growing, slots, len(by_slot), self._loss()[0], width, n_bins)
        find = _best(n_bins, self.l2, self.least_hessian, self.least_rows)
        if table.rdd.getNumPartitions() > 1:
            sums = table.mapInArrow(add, "slot int, feature int, sums binary")
            tasks = -(-len(by_slot) * width // _TASK_SUMS)
            best = sums.repartition(tasks, "slot", "feature").mapInArrow(find, _SPLITS)
        else:
            # The sums of one task have nothing to meet.
            best = table.mapInArrow(lambda batches: find(add(batches)), _SPLITS)
        # A row per open node and task of the second step.
        for r in _tops(map(tuple, best.collect())).values():
            node = by_slot[r[0]]
            node.g, node.h, node.n = r[4:7]
            if r[1] > 1e-12:
                node.split, node.below = (r[1], r[2], r[3]), r[7:10]
