"""Isolation forest (M14; Liu, Ting and Zhou, 2008) and the anomaly facet of the profile.

Each tree sees 256 rows, whatever the size of the table, so fitting is a bounded job: draw the rows for
all trees, grow one tree per group, keep the nodes. Scoring is one pass with the nodes on every executor.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import as_double, numeric_columns
from ..session import written
from .quantiles import exact_quantiles

TREES = 100
SAMPLE = 256
_EULER = 0.5772156649015329

_NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree; a leaf carries its depth plus the expected depth below it."""
    nodes: list[list] = []
    todo = [(np.arange(len(values)), 0, None, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent][2 + side] = here
        block = values[rows]
        low, high = block.min(axis=0), block.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(splittable) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(rows)))])
            continue
        feature = int(rng.choice(splittable))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = block[:, feature] <= cut
        nodes.append([feature, cut, -1, -1, 0.0])
        todo.append((rows[left], depth + 1, here, 0))
        todo.append((rows[~left], depth + 1, here, 1))
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class IsolationForest:
    """A fitted forest: its inputs, its nodes (at most 511 per tree) and the rows each tree saw."""

    columns: tuple[str, ...]
    nodes: tuple[tuple, ...]
    sample: int

    def score(self, df: DataFrame) -> Column:
        """Anomaly score in (0, 1]; larger is stranger. Missing numbers count as zero."""
        trees: dict[int, list] = {}
        for tree, node, *rest in sorted(self.nodes):
            trees.setdefault(tree, []).append(rest)
        packed = [
            (
                np.array([n[0] for n in t]),
                np.array([n[1] for n in t]),
                np.array([n[2] for n in t]),
                np.array([n[3] for n in t]),
                np.array([n[4] for n in t]),
            )
            for t in trees.values()
        ]
        shared = df.sparkSession.sparkContext.broadcast(packed)
        scale = max(float(_average_path(self.sample)), 1e-12)

        @F.pandas_udf(T.DoubleType())
        def score(*parts: pd.Series) -> pd.Series:
            x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
            total = np.zeros(len(x))
            for feature, cut, left, right, depth in shared.value:
                at = np.zeros(len(x), dtype=int)
                active = np.flatnonzero(feature[at] >= 0)
                while len(active):
                    node = at[active]
                    goes_left = x[active, feature[node]] <= cut[node]
                    at[active] = np.where(goes_left, left[node], right[node])
                    active = active[feature[at[active]] >= 0]
                total += depth[at]
            return pd.Series(np.power(2.0, -total / len(shared.value) / scale))

        return score(*[F.coalesce(as_double(df, c), F.lit(0.0)) for c in self.columns])

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "nodes": self.nodes, "sample": self.sample})

    @staticmethod
    def from_json(text: str) -> "IsolationForest":
        raw = json.loads(text)
        return IsolationForest(tuple(raw["columns"]), tuple(tuple(n) for n in raw["nodes"]), raw["sample"])


def _distinct(rng: np.random.Generator, n: int, size: int) -> set[int]:
    """``size`` distinct numbers below ``n``."""
    if 2 * size >= n:
        return set(rng.permutation(n)[:size].tolist())
    found: set[int] = set()
    while len(found) < size:
        found.update(rng.integers(0, n, size - len(found)).tolist())
    return found


def fit_isolation_forest(
    df: DataFrame, columns: Sequence[str] | None = None, trees: int = TREES, sample: int = SAMPLE, seed: int = 42
) -> IsolationForest:
    """Draw ``sample`` rows for each tree, or all if there are fewer, without replacement within a tree, and grow them."""
    wanted = list(numeric_columns(df) if columns is None else columns)
    names = [f"c{i}" for i in range(len(wanted))]
    plain = df.select(*[F.coalesce(as_double(df, c), F.lit(0.0)).alias(n) for c, n in zip(wanted, names)])
    # The number of a row holds the partition that wrote it in its upper bits and its place there in the lower 33.
    numbered = written(plain.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    parts = numbered.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    ends = np.cumsum([r.n for r in parts])
    n = int(ends[-1]) if parts else 0
    size = min(sample, n)
    rng = np.random.default_rng(seed)
    chosen = []
    for tree in range(trees if n else 0):
        for order, row in enumerate(sorted(_distinct(rng, n, size))):
            part = int(np.searchsorted(ends, row, side="right"))
            place = row - int(ends[part - 1] if part else 0)
            chosen.append((tree, order, (parts[part].part << 33) + place))
    # trees * sample rows at most.
    picks = df.sparkSession.createDataFrame(chosen, "__tree int, __r int, __at long")
    dealt = numbered.join(F.broadcast(picks), "__at")
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        nodes = _grow(block.sort_values("__r")[names].to_numpy(dtype=float), np.random.default_rng([seed, tree]), limit)
        frame = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        frame.insert(0, "node", range(len(frame)))
        frame.insert(0, "tree", tree)
        return frame

    rows = dealt.groupBy("__tree").applyInPandas(grow, _NODE_SCHEMA).collect()
    return IsolationForest(tuple(wanted), tuple(tuple(r) for r in rows), size)


def score_cut(df: DataFrame, score: str, contamination: float) -> float | None:
    """The quantile that parts the strangest rows; the scores are computed once for all its passes."""
    scores = df.select(score).persist()
    try:
        return exact_quantiles(scores, (1.0 - contamination,), [score])[score][0]
    finally:
        scores.unpersist()


def flag_anomalies(
    df: DataFrame, score: str, contamination: float = 0.05, output: str = "is_anomaly"
) -> DataFrame:
    """Rows whose score lies above the (1 - contamination) quantile of all scores."""
    cut = score_cut(df, score, contamination)
    return df.withColumn(output, F.col(score) > F.lit(cut))


def anomaly_summary(
    df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.05, seed: int = 42
) -> DataFrame:
    """M14 as a profile facet: how many rows the forest flags; needs 20 rows and a numeric column."""
    wanted = list(numeric_columns(df) if columns is None else columns)
    schema = "available boolean, n_anomalies long, ratio double"
    n = df.count()
    if n < 20 or not wanted:
        return df.sparkSession.createDataFrame([(False, 0, 0.0)], schema)
    forest = fit_isolation_forest(df, wanted, seed=seed)
    scored = written(df.select(forest.score(df).alias("score")), "scores")
    flagged = flag_anomalies(scored, "score", contamination).filter("is_anomaly").count()
    return df.sparkSession.createDataFrame([(True, flagged, round(flagged / n, 4))], schema)
