"""The trees of a forest of ``pyspark.ml`` as arrays, for tasks that change rows many times and predict them again."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from .shap import saved_nodes


@dataclass
class Tree:
    """Nodes by place; a leaf is its own child at every value."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray  # of node i at 2 * i where its value is not above the threshold, else behind
    value: np.ndarray  # node x outputs
    depth: int
    asked: np.ndarray  # node x feature: whether the way to the node asks for it

    @staticmethod
    def of(nodes: list, n_classes: int, n_features: int) -> "Tree":
        n = len(nodes)
        feature = np.array([r.feature for r in nodes])
        asked = np.zeros((n, n_features), bool)
        children, depth = np.repeat(np.arange(n), 2), np.zeros(n, int)
        for i, r in enumerate(nodes):
            if r.feature >= 0:
                children[2 * i : 2 * i + 2] = r.leftChild, r.rightChild
                depth[[r.leftChild, r.rightChild]] = depth[i] + 1
                asked[[r.leftChild, r.rightChild]] = asked[i]
                asked[[r.leftChild, r.rightChild], r.feature] = True
        if n_classes:
            value = np.array([np.array(r.impurityStats) / max(sum(r.impurityStats), 1e-300) for r in nodes])
        else:
            value = np.array([[r.prediction] for r in nodes])
        threshold = np.array([0.0 if r.threshold is None else r.threshold for r in nodes])
        return Tree(np.maximum(feature, 0), threshold, children, value, int(depth.max(initial=0)), asked)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; NaN goes right at every split."""
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = self.children[2 * at + ~(flat[start + self.feature[at]] <= self.threshold[at])]
        return at


@dataclass
class Forest:
    trees: list[Tree]
    n_classes: int

    def leaves(self, x: np.ndarray) -> list[np.ndarray]:
        return [tree.leaves(x) for tree in self.trees]

    def leaves_without(self, x: np.ndarray, known: list[np.ndarray], feature: int) -> list[np.ndarray]:
        """As :meth:`leaves`, for rows whose leaves are ``known`` and of which one feature has changed."""
        found = []
        for tree, at in zip(self.trees, known):
            moved, at = np.flatnonzero(tree.asked[at, feature]), at.copy()
            at[moved] = tree.leaves(x[moved])
            found.append(at)
        return found

    def predict(self, leaves: list[np.ndarray]) -> np.ndarray:
        """The class with most votes, the first among equals, or the mean of the trees."""
        total = np.zeros((len(leaves[0]), self.trees[0].value.shape[1]))
        for tree, at in zip(self.trees, leaves):
            total += tree.value[at]
        return total.argmax(axis=1).astype(float) if self.n_classes else total[:, 0] / len(self.trees)


def forest_of(model, spark: SparkSession) -> Forest | None:
    """The forest of a model of ``pyspark.ml`` without thresholds of its own, None for other models."""
    if type(model).__name__ not in ("RandomForestClassificationModel", "RandomForestRegressionModel"):
        return None
    if model.hasParam("thresholds") and model.isDefined("thresholds"):
        return None
    n_classes = getattr(model, "numClasses", 0)
    return Forest([Tree.of(nodes, n_classes, model.numFeatures) for nodes in saved_nodes(model, spark).values()], n_classes)
