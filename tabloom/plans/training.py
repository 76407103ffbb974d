"""Cross-validated search, training and ranking."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import NOISE, cluster_count, silhouette
from ..operators.split import folds, holdout, position_of
from ..operators.tally import TableTally, collect_tally
from ..session import discard, spread, tasks_for, written
from .heuristics import Plan, ProblemType
from .prepare import Recipe, fit_recipe, label_frame
from .registry import Candidate, Context, candidates
from .search import SEARCH_METRIC, Trial, parameter_points, search, supervised_metrics, winner

PRIMARY_METRIC = SEARCH_METRIC | {
    ProblemType.CLUSTERING: "silhouette_sq",
    ProblemType.ANOMALY_DETECTION: "silhouette_sq",
}

LEADERBOARD_SCHEMA = (
    "rank int, name string, problem_type string, score double, metrics map<string,double>, "
    "params map<string,string>, time_s double, error string"
)


@dataclass(frozen=True)
class Settings:
    trials: int = 15
    cv_folds: int = 5
    seed: int = 42
    valid_share: float = 0.2
    parallel: int = 4
    racing: bool = True


@dataclass
class ModelResult:
    name: str
    problem_type: ProblemType
    metrics: dict[str, float]
    params: dict[str, Any]
    time_s: float = 0.0
    error: str | None = None
    model: Any = None


@dataclass
class Trained:
    """Everything scoring and explaining need: the fitted preparation and the ranked models."""

    problem_type: ProblemType
    target: str | None
    recipe: Recipe
    classes: DataFrame | None
    results: list[ModelResult]
    train: DataFrame
    valid: DataFrame
    names: list[str] = field(default_factory=list)
    scratch: list[DataFrame] = field(default_factory=list)

    @property
    def best(self) -> ModelResult:
        return self.results[0]

    def release(self) -> None:
        """Give back the cached frames and the tables that the training wrote."""
        for frame in (self.train, self.valid):
            frame.unpersist()
        for frame in self.scratch:
            discard(frame)
        self.scratch.clear()


def _kept(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _error(spec: Candidate, exc: Exception) -> ModelResult:
    return ModelResult(spec.name, spec.problem_type, {"error": 0.0}, {}, error=str(exc).splitlines()[0][:500])


def _rank(results: list[ModelResult], problem_type: ProblemType) -> list[ModelResult]:
    """K5: by primary metric, models without one last; equals keep registry order."""
    metric = PRIMARY_METRIC[problem_type]

    def place(r: ModelResult) -> float:
        value = r.metrics.get(metric)
        return float("inf") if value is None or value != value else -value

    return sorted(results, key=place)


def train_supervised(
    df: DataFrame,
    target: str,
    plan: Plan,
    problem_type: ProblemType,
    settings: Settings = Settings(),
    specs: list[Candidate] | None = None,
    key: list[str] | None = None,
    tally: TableTally | None = None,
) -> Trained:
    """V1-V4: split, search each model by cross-validation on the training part, rank on the hold-out."""
    one = tally[target] if tally is not None else collect_tally(df.select(f"`{target}`"))[target]
    labelled, classes = label_frame(df, target, one.n_unique)
    # The label decides the strata only where there are classes.
    is_class = problem_type is ProblemType.CLASSIFICATION
    stratum = "label" if is_class else None
    # However few files the table has, all cores take part; every model reads these rows many times.
    tasks = tasks_for(df.sparkSession, one.n_rows)
    placed = written(spread(labelled.withColumn("__p", position_of(df, key, settings.seed)), tasks), "labelled")
    split = holdout(placed, settings.valid_share, stratum, position=F.col("__p"))
    # A second hash of the position decides the folds, so they do not follow the hold-out cut.
    refold = F.pmod(F.xxhash64("__p"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rest = split.filter("not is_valid")
    inside = written(folds(rest, settings.cv_folds, stratum, position=refold), "train") if settings.cv_folds > 1 else rest
    outside = split.filter("is_valid")
    hidden = ("__p", "is_valid", "fold", "label")
    n_train = inside.count()
    n_classes = classes.count() if classes is not None else 0

    means = "label" if _means_help(is_class, n_classes) else None
    recipe = fit_recipe(inside, plan, target, means, hidden)
    train = _kept(recipe.apply(inside, keep=("label",)))
    valid = _kept(recipe.apply(outside, keep=("label",)))
    context = Context(n_train, len(recipe.feature_names), n_classes, settings.seed)
    specs = specs or candidates(problem_type)
    trials = {spec.name: [Trial(spec, p) for p in parameter_points(spec, settings.trials, settings.seed)] for spec in specs}
    own: dict[int, Recipe] = {}

    # V2: one fold at a time is kept, each prepared from its own training part.
    @contextmanager
    def fold(j: int) -> Iterator[tuple[DataFrame, DataFrame]]:
        part, probe = inside.filter(F.col("fold") != j), inside.filter(F.col("fold") == j)
        if j not in own:
            own[j] = fit_recipe(part, plan, target, means, hidden)
        kept = _kept(own[j].apply(part, keep=("label",))), _kept(own[j].apply(probe, keep=("label",)))
        try:
            yield kept
        finally:
            for frame in kept:
                frame.unpersist()

    n_folds = settings.cv_folds if settings.cv_folds > 1 else 0
    search(trials, fold, n_folds, context, settings.parallel, settings.racing)

    results = []
    for spec in specs:
        started = time.perf_counter()
        try:
            result = _best_of(trials[spec.name], train, valid, context)
            spent = sum(t.time_s for t in trials[spec.name])
            result.time_s = round(spent + time.perf_counter() - started, 2)
            results.append(result)
        except Exception as exc:
            results.append(_error(spec, exc))
    if all(r.error for r in results):
        raise RuntimeError("no model could be trained: " + "; ".join(f"{r.name}: {r.error}" for r in results))
    return Trained(
        problem_type, target, recipe, classes, _rank(results, problem_type), train, valid, recipe.feature_names,
        [placed] + ([inside] if inside is not rest else []),
    )


def _means_help(is_class: bool, n_classes: int) -> bool:
    """A mean label has a meaning for numbers and for two classes."""
    return not is_class or n_classes <= 2


def _best_of(trials: list[Trial], train: DataFrame, valid: DataFrame, context: Context) -> ModelResult:
    """V3: the winner of the folds, fitted on all training rows."""
    best = winner(trials)
    kind = best.spec.problem_type
    model = best.spec.build(best.params, context).fit(train)
    metrics = supervised_metrics(model.transform(valid), kind)
    if PRIMARY_METRIC[kind] not in metrics:
        raise RuntimeError(f"{PRIMARY_METRIC[kind]} is undefined")
    if best.scores:
        metrics["cv_score"] = best.mean
    return ModelResult(best.spec.name, kind, metrics, best.params, model=model)


def unsupervised_metrics(scored: DataFrame, problem_type: ProblemType) -> dict[str, float]:
    """V8/V9; for anomaly models also how many rows were flagged."""
    value = silhouette(scored, noise_counts=True)
    metrics = {
        "silhouette_sq": 0.0 if value is None else value,
        "n_clusters": float(cluster_count(scored).first().n_clusters),
    }
    if problem_type is ProblemType.ANOMALY_DETECTION:
        row = scored.agg(
            F.count_if(F.col("prediction") == NOISE).alias("n"), F.count(F.lit(1)).alias("total")
        ).first()
        metrics["n_anomalies"] = float(row.n)
        metrics["anomaly_ratio"] = round(row.n / max(row.total, 1), 4)
    return metrics


def train_unsupervised(
    df: DataFrame,
    plan: Plan,
    problem_type: ProblemType,
    settings: Settings = Settings(),
    specs: list[Candidate] | None = None,
) -> Trained:
    """V4: every model on all rows with its default parameters, ranked by silhouette."""
    recipe = fit_recipe(df, plan)
    train = _kept(recipe.apply(df))
    context = Context(train.count(), len(recipe.feature_names), 0, settings.seed)
    results = []
    for spec in specs or candidates(problem_type):
        started = time.perf_counter()
        try:
            model = spec.build(dict(spec.params), context).fit(train)
            scored = _kept(model.transform(train))
            metrics = unsupervised_metrics(scored, problem_type)
            scored.unpersist()
            results.append(
                ModelResult(
                    spec.name, problem_type, metrics, dict(spec.params),
                    round(time.perf_counter() - started, 2), model=model,
                )
            )
        except Exception as exc:
            results.append(_error(spec, exc))
    if all(r.error for r in results):
        raise RuntimeError("no model could be trained: " + "; ".join(f"{r.name}: {r.error}" for r in results))
    return Trained(
        problem_type, None, recipe, None, _rank(results, problem_type), train, train, recipe.feature_names
    )


def leaderboard(spark: SparkSession, trained: Trained) -> DataFrame:
    """The models in order: one row each."""
    metric = PRIMARY_METRIC[trained.problem_type]
    rows = [
        (
            i + 1, r.name, r.problem_type.value, r.metrics.get(metric), r.metrics,
            {k: str(v) for k, v in r.params.items()}, r.time_s, r.error,
        )
        for i, r in enumerate(trained.results)
    ]
    return spark.createDataFrame(rows, LEADERBOARD_SCHEMA)


def rank_scores(scores: DataFrame, score: str = "score", name: str = "name") -> DataFrame:
    """The position of each model, the best score first and missing scores last."""
    order = Window.orderBy(F.desc_nulls_last(score), name)
    return scores.withColumn("rank", F.row_number().over(order))


def leaderboard_table(board: DataFrame) -> DataFrame:
    """One row per model, one column per metric that any model reports."""
    each = board.select("rank", "name", "time_s", F.explode("metrics").alias("metric", "value"))
    return each.groupBy("rank", "name", "time_s").pivot("metric").agg(F.first("value")).orderBy("rank")
