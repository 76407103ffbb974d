"""SHAP values of trees (X1): path-dependent, exact, all leaves and rows of a block at once.

A leaf is a product of conditions, one per feature on its path: an interval that a row meets or not, and the share of
the training rows that the splits on that feature pass on. Its contribution to a feature is a Shapley value of that
product, whose coefficients by coalition size are those of the polynomial of (share + met * t) over the features;
taking one factor out again gives all features in the square of the path length, whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .blocks import vector_array
from .boosting import BoostedModel

# Cells of (row, leaf, feature of the path) that are held at a time.
_CELLS = 1_000_000
_ROWS = 64


@dataclass
class Leaves:
    """Leaves by conditions on at most ``width`` features each; conditions that do not exist are always met."""

    feature: np.ndarray  # leaf x width
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    depth: np.ndarray
    value: np.ndarray  # leaf x outputs
    base: np.ndarray  # outputs

    @staticmethod
    def of(trees: list[tuple], n_outputs: int, base: np.ndarray) -> "Leaves":
        """``trees`` are (feature, threshold, left, right, cover, values by output); leaves have feature -1."""
        found = []
        for feature, threshold, left, right, cover, value in trees:
            todo = [(0, {})]
            while todo:
                node, path = todo.pop()
                if feature[node] < 0:
                    found.append((path, value[node]))
                    continue
                f, cut = int(feature[node]), float(threshold[node])
                for child, goes_left in ((int(left[node]), True), (int(right[node]), False)):
                    low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                    if goes_left:
                        high = min(high, cut)
                    else:
                        low = max(low, cut)
                    todo.append((child, {**path, f: (low, high, share * cover[child] / max(cover[node], 1e-300))}))
        found.sort(key=lambda x: len(x[0]))
        width = max((len(p) for p, _ in found), default=0)
        n = len(found)
        out = Leaves(
            np.zeros((n, width), np.int64), np.full((n, width), -np.inf), np.full((n, width), np.inf), np.ones((n, width)),
            np.array([len(p) for p, _ in found], np.int64), np.array([v for _, v in found], float).reshape(n, n_outputs), base,
        )
        for i, (path, _) in enumerate(found):
            for j, (f, (low, high, share)) in enumerate(path.items()):
                out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = f, low, high, share
        return out

    def expected(self) -> np.ndarray:
        """The mean prediction that the values add up from."""
        return self.base + (self.value * self.share.prod(axis=1)[:, None]).sum(axis=0)

    def values(self, x: np.ndarray) -> np.ndarray:
        """(row, feature, output) of a block of rows; NaN goes right at every split."""
        x = np.where(np.isnan(x), np.inf, x)
        total = np.zeros((len(x), x.shape[1], self.value.shape[1]))
        at = 0
        while at < len(self.depth):
            # Leaves come by path length, so a run of them has nearly the same number of conditions.
            end = at + max(1, _CELLS // max(len(x) * max(int(self.depth[at]), 1), 1))
            end = min(end, int(np.searchsorted(self.depth, 2 * max(self.depth[at], 1), side="right")), len(self.depth))
            width = int(self.depth[end - 1])
            if width:
                self._add(total, x, slice(at, end), width)
            at = end
        return total

    def _add(self, total: np.ndarray, x: np.ndarray, leaves: slice, width: int) -> None:
        feature, share = self.feature[leaves, :width], self.share[leaves, :width]
        cell = x[:, feature]
        met = (cell > self.low[leaves, :width]) & (cell <= self.high[leaves, :width])
        # Coefficients by coalition size; padded conditions are players that change nothing.
        ways = np.zeros((*met.shape[:2], width + 1))
        ways[..., 0] = 1.0
        for i in range(width):
            grown = ways * share[:, i, None]
            grown[..., 1:] += ways[..., :-1] * met[..., i, None]
            ways = grown
        weight = np.array([factorial(s) * factorial(width - 1 - s) / factorial(width) for s in range(width)])
        part = np.zeros(met.shape)
        for i in range(width):
            z, hit = share[:, i], met[..., i]
            # Without the factor (z + t) where the condition is met, from the top; without z where it is not.
            rest, with_it = ways[..., width].copy(), np.zeros(hit.shape)
            for s in range(width - 1, -1, -1):
                with_it += rest * weight[s]
                rest = ways[..., s] - z * rest
            without = (ways[..., :width] * weight).sum(axis=-1) / np.maximum(z, 1e-300)
            part[..., i] = np.where(hit, (1.0 - z) * with_it, -z * without)
        flat = part.reshape(len(x), -1)
        owner = feature.ravel()
        for k in range(self.value.shape[1]):
            to = np.zeros((len(owner), x.shape[1]))
            to[np.arange(len(owner)), owner] = np.repeat(self.value[leaves, k], width)
            total[..., k] += flat @ to


def _of_boosted(model: BoostedModel) -> Leaves:
    n = len(model.base)
    trees = []
    for one_round in model.rounds:
        for k, t in enumerate(one_round):
            value = np.zeros((len(t.value), n))
            value[:, k] = t.value
            trees.append((t.feature, t.threshold, t.left, t.right, t.cover, value))
    return Leaves.of(trees, n, np.array(model.base))


def saved_nodes(model, spark: SparkSession) -> dict[int, list]:
    """The saved nodes of each tree of ``pyspark.ml``, as many as the model on the driver has."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select("treeID", "nodeData.*")
    else:
        table = table.select(F.lit(0).alias("treeID"), "*")
    rows = table.select(
        "treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("split.numCategories").alias("categories"),
    ).orderBy("treeID", "id").collect()
    if any(r.categories > 0 for r in rows):
        raise ValueError("splits by sets of categories are not supported")
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r.treeID, []).append(r)
    return by_tree


def _of_spark(model, spark: SparkSession) -> Leaves:
    by_tree = saved_nodes(model, spark)
    n_classes = getattr(model, "numClasses", 0)
    weights = getattr(model, "treeWeights", None)
    # The margin of boosted classes adds up predictions; forests average the shares of the classes.
    averaged = type(model).__name__.startswith("RandomForest")
    shares = bool(n_classes) and not type(model).__name__.startswith("GBT")
    trees = []
    for tree_id, nodes in by_tree.items():
        scale = 1.0 / len(by_tree) if averaged else weights[tree_id] if weights else 1.0
        value = [np.array(n.impurityStats) / max(sum(n.impurityStats), 1e-300) if shares else np.array([n.prediction]) for n in nodes]
        trees.append((
            np.array([n.feature for n in nodes]), np.array([n.threshold if n.threshold is not None else 0.0 for n in nodes]),
            np.array([n.leftChild for n in nodes]), np.array([n.rightChild for n in nodes]),
            np.array([n.rawCount for n in nodes], float), np.array(value) * scale,
        ))
    n_outputs = trees[0][5].shape[1]
    return Leaves.of(trees, n_outputs, np.zeros(n_outputs))


def leaves_of(model, spark: SparkSession) -> Leaves | None:
    """The leaves of a boosted model of this package or a tree model of ``pyspark.ml``, None for others."""
    if isinstance(model, BoostedModel):
        return _of_boosted(model)
    if hasattr(model, "featureImportances") and hasattr(model, "write"):
        return _of_spark(model, spark)
    return None


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    for at in range(0, len(x), _ROWS):
        yield at, x[at : at + _ROWS]


def shap_values(df: DataFrame, model, features: str = "features", output: str = "shap") -> DataFrame:
    """Add the values of each row: an array over outputs (one for numbers and two classes) of arrays over features.

    They add up to the raw prediction less its expectation. An empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(leaves_of(model, df.sparkSession))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for _, x in _blocks(batch):
                found += shared.value.values(x).transpose(0, 2, 1).tolist()
            told = pa.array(found, pa.list_(pa.list_(pa.float64())))
            kept = [batch.column(c) for c in names if c != features]
            yield pa.RecordBatch.from_arrays([*kept, batch.column("x"), told], names=[*(c for c in names if c != features), "x", output])

    lean = df.withColumn("x", vector_array(df, features)).drop(features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema.fields)
    return lean.mapInArrow(run, f"{schema}, `{output}` array<array<double>>")


def mean_abs_shap(df: DataFrame, model, names: list[str], features: str = "features") -> DataFrame:
    """(feature, importance): the mean absolute value of each feature over all rows and outputs; zeros without rows."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(leaves_of(model, spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(names)), 0
        for batch in batches:
            for _, x in _blocks(batch):
                total += np.abs(shared.value.values(x)).mean(axis=2).sum(axis=0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(total), pa.array(np.full(len(names), n))], names=["at", "total", "n"])

    sums = df.select(vector_array(df, features).alias("x")).mapInArrow(run, "at bigint, total double, n bigint")
    every = spark.createDataFrame(list(enumerate(names)), "at bigint, feature string")
    told = sums.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("importance"))
    return every.join(F.broadcast(told), "at", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
