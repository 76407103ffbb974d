"""The full run and its report tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import CATEGORICAL, DATETIME, columns_of, drop_columns, normalize, numeric_columns
from ..operators.correlation import correlations, top_pairs
from ..operators.isolation import anomaly_summary
from ..operators.profile import (
    boxplots,
    categorical_summary,
    class_balance,
    class_balance_summary,
    column_info,
    describe_numeric,
    duplicate_count,
    histograms,
    missing,
    missing_totals,
    outliers,
    shape,
    target_distribution,
)
from ..operators.tally import TableTally, collect_tally
from ..operators.temporal import temporal_summary
from .explain import explain_clusters, feature_importance, top_features
from .heuristics import (
    Plan,
    ProblemType,
    detect_problem_type,
    id_columns_frame,
    plan_frame,
    rank_targets,
    suggest_plan,
    target_frame,
)
from .quality import gather, insights, quality_breakdown, quality_score
from .registry import Candidate
from .scoring import Scorer
from .training import PRIMARY_METRIC, Settings, Trained, leaderboard, train_supervised, train_unsupervised


@dataclass
class RunResult:
    problem_type: ProblemType
    target: str | None
    plan: Plan
    facets: dict[str, DataFrame]
    trained: Trained | None = None
    status: str = "trained"
    notes: list[str] = field(default_factory=list)

    def overview(self, spark: SparkSession) -> DataFrame:
        """(item, value): type, target, status, notes, the plan and the best model with its settings."""
        rows = [("problem_type", self.problem_type.value), ("target", self.target), ("status", self.status)]
        rows += [("note", note) for note in self.notes]
        rows.append(("plan", json.dumps(asdict(self.plan), sort_keys=True)))
        if self.trained is not None:
            best = self.trained.best
            rows += [("best_model", best.name)]
            rows += [("parameter", f"{k}={v}") for k, v in best.params.items()]
            rows += [("metric", f"{k}={v}") for k, v in best.metrics.items()]
        return spark.createDataFrame(rows, "item string, value string")

    def write(self, spark: SparkSession, path: str) -> None:
        """The overview, one folder per facet, and the best model with its preparation."""
        self.overview(spark).write.parquet(f"{path}/overview")
        for name, frame in self.facets.items():
            frame.write.parquet(f"{path}/facets/{name}")
        if self.trained is not None:
            Scorer.of(self.trained).save(spark, f"{path}/scorer")


def dataset_summary(
    df: DataFrame, dataset_id: str, name: str, target: str | None = None, problem_type: ProblemType | None = None
) -> DataFrame:
    """One row: identity, shape, the planner's size estimate, and the columns as nested rows."""
    info = column_info(df)
    nested = info.agg(
        F.sort_array(
            F.collect_list(F.struct("position", "column", "dtype", "kind", "n_unique", "n_missing", "example"))
        ).alias("columns_info")
    )
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return (
        shape(df)
        .select("n_rows", "n_columns")
        .join(F.broadcast(nested))
        .select(
            F.lit(dataset_id).alias("dataset_id"),
            F.lit(name).alias("name"),
            "n_rows",
            "n_columns",
            F.lit(size).cast("long").alias("size_bytes"),
            "columns_info",
            F.lit(target).cast("string").alias("target"),
            F.lit(problem_type.value if problem_type else None).cast("string").alias("problem_type"),
            F.lit(datetime.now(timezone.utc).isoformat()).alias("created_at"),
        )
    )


def profile(df: DataFrame, target: str | None = None, tally: TableTally | None = None) -> dict[str, DataFrame]:
    """All profile facets. Identifier columns are left out of the analysed ones.

    What the quality rules read is computed once and handed on as rows.
    """
    df = normalize(df)
    tally = tally or collect_tally(df)
    evidence = gather(df, target, tally)
    analysed = drop_columns(df, evidence.ids)

    def known(lazy: DataFrame, rows) -> DataFrame:
        return df.sparkSession.createDataFrame(list(rows), lazy.schema)

    anomalies = anomaly_summary(analysed, numeric_columns(analysed))
    pairs = correlations(analysed)
    facets = {
        "shape": shape(df),
        "id_columns": id_columns_frame(df, tally),
        "describe": describe_numeric(analysed),
        "missing": known(missing(df), evidence.missing),
        "missing_totals": missing_totals(df),
        "duplicates": duplicate_count(df, tally),
        "correlations": pairs,
        "top_pairs": top_pairs(analysed),
        "outliers": known(outliers(analysed), evidence.outliers),
        "histograms": histograms(analysed),
        "boxplots": boxplots(analysed),
        "categorical": categorical_summary(analysed, columns_of(analysed, CATEGORICAL)),
        "anomalies": anomalies,
        "quality": quality_score(df, target, evidence),
        "quality_breakdown": quality_breakdown(df, target, evidence),
        "insights": insights(df, target, evidence, anomalies=anomalies.first()),
    }
    if columns_of(df, DATETIME):
        facets["temporal"] = temporal_summary(df)
    if target in df.columns:
        facets["class_balance"] = class_balance(df, target)
        facets["class_balance_summary"] = class_balance_summary(df, target)
        facets["target_distribution"] = target_distribution(df, target)
    return facets


def run(
    df: DataFrame,
    target: str | None = None,
    auto_target: bool = False,
    problem_type: ProblemType | None = None,
    settings: Settings = Settings(),
    specs: list[Candidate] | None = None,
    key: list[str] | None = None,
    profiled: bool = True,
    screened: bool = False,
) -> RunResult:
    """Profile, choose a target and type, plan, train, explain.

    With ``screened`` distinct counts are sketched first and counted exactly only where a rule depends on them.
    """
    df = normalize(df)
    tally = collect_tally(df, screened=screened)
    suggestions = target_frame(df, None, tally)
    if target is None and auto_target:
        ranked = rank_targets(df, None, tally)
        target = ranked[0].column if ranked else None
    kind = problem_type or detect_problem_type(df, target, tally)
    plan = suggest_plan(df, target, tally)
    facets = profile(df, target, tally) if profiled else {}
    facets["targets"] = suggestions
    facets["dataset"] = dataset_summary(df, "run", "table", target, kind)
    facets["plan"] = plan_frame(df, plan)
    result = RunResult(kind, target, plan, facets)
    if kind is ProblemType.TIME_SERIES:
        result.status = "not_trained: no model forecasts a time series"
        return result
    if kind in (ProblemType.CLASSIFICATION, ProblemType.REGRESSION):
        if target is None:
            raise ValueError(f"{kind.value} needs a target")
        trained = train_supervised(df, target, plan, kind, settings, specs, key, tally)
    else:
        trained = train_unsupervised(df, plan, kind, settings, specs)
    result.trained = trained
    facets["leaderboard"] = leaderboard(df.sparkSession, trained)
    try:
        if trained.target is not None:
            method, importance = feature_importance(trained)
            result.notes.append(f"importance: {method}")
            facets["importance"] = top_features(importance)
        else:
            for name, frame in explain_clusters(trained, df).items():
                facets[f"clusters_{name}"] = frame
    except Exception as exc:
        result.notes.append(f"explanation failed: {exc}")
    return result


def report(result: RunResult) -> dict[str, DataFrame]:
    """O2: the tables of a report: overview, quality, insights, plan, leaderboard, top ten importances."""
    wanted = ("shape", "quality", "quality_breakdown", "insights", "plan", "leaderboard")
    tables = {name: result.facets[name] for name in wanted if name in result.facets}
    if "importance" in result.facets:
        tables["importance"] = result.facets["importance"].filter("rank <= 10")
    return tables


def executive_summary(result: RunResult, df: DataFrame) -> DataFrame:
    """O3: (item, value): type, shape, best model and the three leaders."""
    rows = [("problem_type", result.problem_type.value), ("columns", str(len(df.columns)))]
    if result.trained is not None:
        metric = PRIMARY_METRIC[result.problem_type]
        best = result.trained.best
        rows += [("best_model", best.name), (metric, f"{best.metrics.get(metric, 0.0):.4f}")]
        rows += [
            (f"top_{i + 1}", f"{r.name}: {r.metrics.get(metric, 0.0):.4f}")
            for i, r in enumerate(result.trained.results[:3])
        ]
    fixed = df.sparkSession.createDataFrame(rows, "item string, value string")
    counted = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("rows").alias("item"), "value")
    return fixed.unionByName(counted)
