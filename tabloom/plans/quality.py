"""Quality score and insights (H6, H7) from the profile facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from ..functions.kinds import drop_columns, numeric_columns
from ..operators.isolation import anomaly_summary
from ..operators.profile import class_balance_summary, duplicate_count, missing, outliers
from ..operators.tally import TableTally, collect_tally
from .heuristics import id_reasons

# Points lost per column above a missing share, and per table above a duplicate share.
MISSING_POINTS = ((0.50, 12), (0.20, 5), (0.05, 2))
DUPLICATE_POINTS = ((0.10, 10), (0.01, 3))
GRADES = ((85, "excellent"), (70, "good"), (50, "fair"), (0, "poor"))


@dataclass(frozen=True)
class Evidence:
    """The facet rows that scoring rules read: a few rows per column of the table."""

    n_rows: int
    ids: tuple[str, ...]
    missing: tuple
    n_duplicates: int
    outliers: tuple
    balance: object | None


def gather(df: DataFrame, target: str | None = None, tally: TableTally | None = None) -> Evidence:
    tally = tally or collect_tally(df)
    ids = tuple(id_reasons(df, tally))
    analysed = drop_columns(df, ids)
    return Evidence(
        n_rows=tally.n_rows,
        ids=ids,
        missing=tuple(missing(df).orderBy("position").collect()),
        n_duplicates=duplicate_count(df, tally).first().n_duplicates,
        outliers=tuple(outliers(analysed).orderBy("position").collect()),
        balance=class_balance_summary(df, target).first() if target in df.columns else None,
    )


def _top_names(rows, key: str, k: int = 3) -> str:
    return ",".join(r["column"] for r in sorted(rows, key=lambda r: -r[key])[:k])


def _points(ratio: float, table) -> int:
    return next((points for above, points in table if ratio > above), 0)


def penalties(e: Evidence) -> list[tuple[int, str, str, float]]:
    """(points, code, detail, measure), the largest first."""
    lost = [(_points(r.ratio, MISSING_POINTS), "missing", r["column"], float(r.ratio)) for r in e.missing]
    ratio = e.n_duplicates / max(e.n_rows, 1)
    lost.append((_points(ratio, DUPLICATE_POINTS), "duplicates", str(e.n_duplicates), round(ratio, 4)))
    lost.append((min(8, 2 * len(e.ids)), "identifiers", ",".join(e.ids), float(len(e.ids))))
    lost.append(
        (min(15, 3 * len(e.outliers)), "outliers", _top_names(e.outliers, "n_outliers"), float(len(e.outliers)))
    )
    if e.balance is not None and e.balance.is_imbalanced:
        lost.append((5, "imbalance", e.balance.target, float(e.balance.majority_minority_ratio)))
    return sorted((p for p in lost if p[0] > 0), key=lambda p: -p[0])


def score_of(lost) -> tuple[int, str]:
    score = max(0, min(100, 100 - sum(p[0] for p in lost)))
    return score, next(name for least, name in GRADES if score >= least)


def quality_breakdown(df: DataFrame, target: str | None = None, evidence: Evidence | None = None) -> DataFrame:
    """H6: why points were lost."""
    rows = penalties(evidence or gather(df, target))
    return df.sparkSession.createDataFrame(
        [(i + 1, *r) for i, r in enumerate(rows)],
        "rank int, points int, code string, detail string, measure double",
    )


def quality_score(df: DataFrame, target: str | None = None, evidence: Evidence | None = None) -> DataFrame:
    """H6: the score from 0 to 100 and its grade."""
    lost = penalties(evidence or gather(df, target))
    score, grade = score_of(lost)
    return df.sparkSession.createDataFrame([(score, grade, len(lost))], "score int, grade string, n_issues int")


def insights(
    df: DataFrame,
    target: str | None = None,
    evidence: Evidence | None = None,
    anomaly_threshold: float = 0.1,
    contamination: float = 0.05,
    anomalies: Row | None = None,
) -> DataFrame:
    """H7: (rank, code, detail, measure): what a reader should know first.

    A forest flags a fixed share of the rows, so it is fitted, unless its summary is given as ``anomalies``, only
    where that share can reach the threshold; otherwise the code ``anomalies`` cannot occur.
    """
    e = evidence or gather(df, target)
    found: list[tuple[str, str, float]] = []
    if e.ids:
        found.append(("identifiers", ",".join(e.ids), float(len(e.ids))))
    if e.missing:
        found.append(("missing", _top_names(e.missing, "n_missing"), float(sum(r.n_missing for r in e.missing))))
    if e.n_duplicates:
        found.append(("duplicates", str(e.n_duplicates), float(e.n_duplicates)))
    if e.balance is not None and e.balance.is_imbalanced:
        found.append(("imbalance", e.balance.target, float(e.balance.majority_minority_ratio)))
    if e.outliers:
        found.append(("outliers", _top_names(e.outliers, "n_outliers"), float(len(e.outliers))))
    if anomalies is None and contamination + 1 / max(e.n_rows, 1) > anomaly_threshold:
        analysed = drop_columns(df, e.ids)
        anomalies = anomaly_summary(analysed, numeric_columns(analysed), contamination).first()
    if anomalies is not None and anomalies.available and anomalies.ratio > anomaly_threshold:
        found.append(("anomalies", str(anomalies.n_anomalies), float(anomalies.ratio)))
    found = found or [("clean", "", 0.0)]
    return df.sparkSession.createDataFrame(
        [(i + 1, *r) for i, r in enumerate(found)], "rank int, code string, detail string, measure double"
    )
