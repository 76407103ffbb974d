"""What is trained for each problem type.

A candidate is a name, a way to build an estimator, and Spark parameters: those of the plain fit, and the values a
search may try. Estimators are those of ``pyspark.ml`` or objects of this package with the same
``fit(df).transform(df)`` surface. ``BOARD`` lists the candidates in training order; more can be added at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import classification, clustering, regression

from ..operators.boosting import BoostedTrees
from ..operators.dbscan import DensityClusters
from ..operators.kernel import KernelClassifier, OneClassMachine
from ..operators.neighbors import LocalOutlierFactor, NearestNeighbors
from ..operators.outlier_models import IsolationForestEstimator
from ..operators.perceptron import Perceptron
from ..operators.ward import WardClusters
from .heuristics import ProblemType

# Forests "without a limit" stop here: a tree of that depth has at most 32,768 leaves, so 200 of them fit a driver.
FOREST_DEPTH = 15


@dataclass(frozen=True)
class Context:
    n_rows: int
    n_features: int
    n_classes: int = 0
    seed: int = 42


@dataclass(frozen=True)
class PerRow:
    """A penalty on the summed loss, as a share of the mean loss that Spark minimises."""

    value: float

    def of(self, context: Context) -> float:
        return self.value / max(context.n_rows, 1)

    def __str__(self) -> str:
        return f"{self.value:g}/rows"


Params = Mapping[str, Any]


@dataclass(frozen=True)
class Candidate:
    name: str
    problem_type: ProblemType
    build: Callable[[Params, Context], Any]
    params: Params = field(default_factory=dict)
    grid: Mapping[str, tuple] = field(default_factory=dict)


def _estimator(kind: type, **fixed) -> Callable[[Params, Context], Any]:
    """Build a Spark estimator from its own parameters."""

    def build(params: Params, context: Context):
        given = {k: v.of(context) if isinstance(v, PerRow) else v for k, v in {**fixed, **params}.items()}
        if hasattr(kind, "setSeed"):
            given["seed"] = context.seed
        return kind(**given)

    return build


def _boosting(params: Params, context: Context) -> BoostedTrees:
    """One model for any number of classes; 0 classes are numbers."""
    return BoostedTrees(
        rounds=params["maxIter"], step=params["stepSize"], max_depth=params.get("maxDepth"), max_leaves=params.get("maxLeaves"),
        n_classes=context.n_classes, l2=params.get("l2", 1.0),
    )


def _perceptron(params: Params, context: Context) -> Perceptron:
    return Perceptron(tuple(params["hidden"]), params["alpha"], context.n_classes, seed=context.seed)


class RestartedKMeans:
    """K-means from several seeds; the fit with the smallest cost wins."""

    def __init__(self, k: int, restarts: int, seed: int):
        self.k, self.restarts, self.seed = k, restarts, seed

    def fit(self, df):
        runs = [clustering.KMeans(k=self.k, seed=self.seed + i).fit(df) for i in range(self.restarts)]
        return min(runs, key=lambda m: m.summary.trainingCost)


def _board() -> dict[ProblemType, tuple[Candidate, ...]]:
    """Names and values are fixed: the models, plain settings and search values that results are compared by."""
    board: dict[ProblemType, list[Candidate]] = {}

    def add(kind: ProblemType, name: str, build, params: Params = {}, **grid: tuple) -> None:
        board.setdefault(kind, []).append(Candidate(name, kind, build, params, grid))

    ml, depths = ProblemType, (FOREST_DEPTH, 10, 20)
    boosting = {"maxIter": (200, 400), "stepSize": (0.05, 0.1)}
    by_depth, by_leaves = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1}, {"maxIter": 200, "maxLeaves": 31, "stepSize": 0.1}

    # Penalties are the inverse of 0.1, 1 and 5 (0.5, 1 and 5 for the support vectors), spread over the rows.
    add(ml.CLASSIFICATION, "LogisticRegression",
        _estimator(classification.LogisticRegression, maxIter=1000, standardization=False),
        {"regParam": PerRow(1.0)}, regParam=(PerRow(10.0), PerRow(1.0), PerRow(0.2)))
    add(ml.CLASSIFICATION, "RandomForest", _estimator(classification.RandomForestClassifier),
        {"numTrees": 200, "maxDepth": FOREST_DEPTH, "minInstancesPerNode": 1},
        numTrees=(100, 300), maxDepth=depths, minInstancesPerNode=(1, 2))
    add(ml.CLASSIFICATION, "BoostedTrees", _boosting, by_depth, **boosting, maxDepth=(3, 4, 6, 8))
    add(ml.CLASSIFICATION, "BoostedLeaves", _boosting, by_leaves, **boosting, maxLeaves=(15, 31))
    add(ml.CLASSIFICATION, "KNN", lambda p, c: NearestNeighbors(p["k"], p["weights"]),
        {"k": 5, "weights": "uniform"}, k=(3, 5, 11), weights=("uniform", "distance"))
    add(ml.CLASSIFICATION, "SVM", lambda p, c: KernelClassifier(p["kernel"], p["regParam"].of(c), c.n_classes, seed=c.seed),
        {"regParam": PerRow(1.0), "kernel": "rbf"}, regParam=(PerRow(2.0), PerRow(1.0), PerRow(0.2)), kernel=("rbf", "linear"))
    add(ml.CLASSIFICATION, "MLP", _perceptron, {"hidden": (64, 32), "alpha": 1e-4}, hidden=((64,), (64, 32)), alpha=(1e-4, 1e-3))

    # One-hot columns keep every level, so many lines fit equally; a trace of ridge picks the smallest.
    add(ml.REGRESSION, "LinearRegression", _estimator(regression.LinearRegression, regParam=1e-8))
    add(ml.REGRESSION, "RandomForest", _estimator(regression.RandomForestRegressor),
        {"numTrees": 200, "maxDepth": FOREST_DEPTH}, numTrees=(100, 300), maxDepth=depths)
    add(ml.REGRESSION, "BoostedTrees", _boosting, by_depth, **boosting, maxDepth=(3, 4, 6, 8))
    add(ml.REGRESSION, "BoostedLeaves", _boosting, by_leaves, **boosting, maxLeaves=(15, 31))
    add(ml.REGRESSION, "GradientBoosting", _boosting, {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "l2": 0.0}, maxIter=(100, 300), maxDepth=(3, 5), stepSize=(0.05, 0.1))

    add(ml.CLUSTERING, "KMeans", lambda p, c: RestartedKMeans(p["k"], p["restarts"], c.seed),
        {"k": 4, "restarts": 10}, k=(3, 4, 5, 8))
    add(ml.CLUSTERING, "DBSCAN", lambda p, c: DensityClusters(p["eps"], p["min_points"]),
        {"eps": 0.5, "min_points": 5}, eps=(0.3, 0.5, 0.8), min_points=(3, 5, 10))
    add(ml.CLUSTERING, "Agglomerative", lambda p, c: WardClusters(p["k"]), {"k": 4}, k=(3, 4, 5))

    add(ml.ANOMALY_DETECTION, "IsolationForest", lambda p, c: IsolationForestEstimator(p["contamination"], seed=c.seed),
        {"contamination": 0.05}, contamination=(0.05, 0.1))
    add(ml.ANOMALY_DETECTION, "OneClassSVM", lambda p, c: OneClassMachine(p["nu"], seed=c.seed), {"nu": 0.05}, nu=(0.05, 0.1))
    add(ml.ANOMALY_DETECTION, "LocalOutlierFactor", lambda p, c: LocalOutlierFactor(p["k"], p["contamination"]),
        {"k": 20, "contamination": 0.05}, k=(10, 20))
    return {kind: tuple(found) for kind, found in board.items()}


BOARD = _board()
_ADDED: dict[tuple[ProblemType, str], Candidate] = {}


def add_candidate(candidate: Candidate) -> None:
    """Train this one too; a candidate of the same problem type and name is replaced."""
    _ADDED[candidate.problem_type, candidate.name] = candidate


def candidates(problem_type: ProblemType) -> list[Candidate]:
    """The candidates of a problem type in training order."""
    if problem_type not in BOARD:
        raise ValueError(f"no models for {problem_type.value}")
    named = {c.name: c for c in BOARD[problem_type]}
    named.update({name: c for (kind, name), c in _ADDED.items() if kind is problem_type})
    return list(named.values())


def candidate(problem_type: ProblemType, name: str, **params) -> Candidate:
    """One candidate without a search, with some of its parameters set."""
    found = next(c for c in candidates(problem_type) if c.name == name)
    return Candidate(found.name, problem_type, found.build, {**found.params, **params})
