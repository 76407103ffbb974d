"""V3: search by cross-validation. Trials run side by side, and those that can no longer win are stopped."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ..operators.metrics import classification_metrics, regression_metrics
from .heuristics import ProblemType
from .registry import Candidate, Context

SEARCH_METRIC = {ProblemType.CLASSIFICATION: "f1_weighted", ProblemType.REGRESSION: "r2"}
# No fold can score more than this by either metric.
CEILING = 1.0
_SLACK = 1e-9

Fold = AbstractContextManager[tuple[DataFrame, DataFrame]]


def parameter_points(spec: Candidate, trials: int, seed: int) -> list[dict[str, Any]]:
    """The defaults first, then a seeded random subset of the grid."""
    points = [dict(spec.params)]
    if spec.grid and trials > 1:
        grid = [dict(zip(spec.grid, v)) for v in product(*spec.grid.values())]
        grid = [{**spec.params, **p} for p in grid]
        others = [p for p in grid if p != points[0]]
        points += random.Random(seed).sample(others, min(trials - 1, len(others)))
    return points


def supervised_metrics(scored: DataFrame, problem_type: ProblemType) -> dict[str, float]:
    measure = classification_metrics if problem_type is ProblemType.CLASSIFICATION else regression_metrics
    row = measure(scored).first()
    return {k: float(v) if v is not None else float("nan") for k, v in row.asDict().items()}


@dataclass
class Trial:
    """One candidate with one choice of parameters, and its scores on the folds so far."""

    spec: Candidate
    params: dict[str, Any]
    scores: list[float] = field(default_factory=list)
    failed: Exception | None = None
    stopped: bool = False
    time_s: float = 0.0

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores) if self.scores else float("nan")

    @property
    def known(self) -> float:
        """The mean so far, the lowest where there is none."""
        return float("-inf") if self.failed is not None or math.isnan(self.mean) else self.mean

    def run(self, train: DataFrame, probe: DataFrame, context: Context) -> None:
        started = time.perf_counter()
        try:
            model = self.spec.build(self.params, context).fit(train)
            kind = self.spec.problem_type
            self.scores.append(supervised_metrics(model.transform(probe), kind)[SEARCH_METRIC[kind]])
        except Exception as exc:
            self.failed = exc
        self.time_s += time.perf_counter() - started


def _side_by_side(trials: Iterable[Trial], fold: Fold, context: Context, parallel: int) -> None:
    """Run trials on one fold from a pool of threads, each in a scheduler pool of its own."""
    with fold as (train, probe), ThreadPoolExecutor(max(1, parallel)) as threads:
        spark = train.sparkSession

        def run(trial: Trial, name: str) -> None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            trial.run(train, probe, context)

        runs = [threads.submit(inheritable_thread_target(spark)(run), t, f"trial-{i}") for i, t in enumerate(trials)]
        for each in runs:
            each.result()


def search(
    trials: dict[str, list[Trial]],
    fold: Callable[[int], Fold],
    n_folds: int,
    context: Context,
    parallel: int = 4,
    racing: bool = True,
) -> None:
    """Score the trials of each model on all folds; ``fold(j)`` gives the training and the probe rows of fold j.

    With ``racing`` all trials see the first fold, the best one of each model then goes through the others, and the
    rest follow as long as full marks on the folds that remain could still lift them to the best complete mean. A
    stopped trial is below that mean whatever it would have scored, so the winner is that of the full search, ties
    included. A trial that fails or scores NaN sets no bound. One fold is kept at a time; the folds are prepared a
    second time for the trials that follow. What is stopped is settled between folds, so timing does not matter.
    """

    def live(group: list[Trial]) -> list[Trial]:
        return [t for t in group if t.failed is None and not t.stopped]

    groups = list(trials.values())
    if not racing:
        for j in range(n_folds):
            _side_by_side([t for g in groups for t in live(g)], fold(j), context, parallel)
        return
    if n_folds:
        _side_by_side([t for g in groups for t in live(g)], fold(0), context, parallel)
    first = [max(live(g), key=lambda t: t.known) for g in groups if live(g)]
    for j in range(1, n_folds):
        ahead = [t for t in first if t.failed is None]
        if ahead:
            _side_by_side(ahead, fold(j), context, parallel)
    for j in range(1, n_folds):
        behind = []
        for group in groups:
            best = max((t.known for t in group if len(t.scores) == n_folds), default=float("-inf")) * n_folds
            for t in live(group):
                if len(t.scores) == j:
                    t.stopped = sum(t.scores) + CEILING * (n_folds - j) < best - _SLACK
                    behind += [] if t.stopped else [t]
        if behind:
            _side_by_side(behind, fold(j), context, parallel)


def winner(trials: list[Trial]) -> Trial:
    """The trial with the best mean over all folds, the first of equals; without folds the first trial."""
    tried = [t for t in trials if t.failed is None and not t.stopped]
    if not tried:
        raise next(t.failed for t in trials if t.failed is not None)
    return max(tried, key=lambda t: t.known) if tried[0].scores else tried[0]
