"""Column rules (H1-H5, H9, H10): pure functions of the per-column tally, plus their DataFrame form."""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import (
    BOOLEAN,
    CATEGORICAL,
    DATETIME,
    NESTED,
    as_double,
    col,
    columns_of,
    kind_of,
    numeric_columns,
    plan_numeric_columns,
)
from ..functions.scalars import is_hash_like
from ..operators.correlation import top_pairs
from ..operators.tally import ColumnTally, TableTally, collect_tally

# What identifier names look like.
ID_NAME_PATTERNS = (
    r"(^|_)id($|_)",
    r"_id$",
    r"^(uuid|guid|hash|token|key|sku|code|ref|reference)$",
    r"(tweet|user|post|comment|message|document|record|order|invoice|transaction|tracking)_?id",
    r"^(index|rowid|rownum)$",
)

# Parts of a name that hint at a target column.
TARGET_HINTS = (
    "target", "label", "y", "class", "output", "response", "outcome",
    "sentiment", "category", "churn", "fraud", "spam", "risk", "score",
)

ID_RATIO = 0.98
UNIQUE_RATIO = 0.999


class ProblemType(str, enum.Enum):
    CLASSIFICATION = "classification"
    REGRESSION = "regression"
    CLUSTERING = "clustering"
    ANOMALY_DETECTION = "anomaly_detection"
    TIME_SERIES = "time_series"


class Ranked(NamedTuple):
    """A column that may be the target."""

    column: str
    problem_type: ProblemType
    score: float
    reasons: tuple[str, ...]


@dataclass(frozen=True)
class Plan:
    """How a table is prepared: immutable, exported by :func:`plan_frame`."""

    drop: dict[str, str] = field(default_factory=dict)
    imputation: dict[str, str] = field(default_factory=dict)
    encoders: dict[str, str] = field(default_factory=dict)
    scaling: str = "standard"
    reduction: str | None = None
    date_features: tuple[str, ...] = ()
    ratios: bool = False
    notes: dict[str, str] = field(default_factory=dict)


_ID_NAME = re.compile("|".join(f"(?:{p})" for p in ID_NAME_PATTERNS), re.IGNORECASE)


def looks_like_id(name: str) -> bool:
    """some identifier pattern occurs in the name."""
    return _ID_NAME.search(name.strip()) is not None


def hash_like_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """H2: mean length of at least 16 and at least 90 % hash-like values, over the whole column."""
    if not columns:
        return set()
    row = df.agg(
        *[F.avg(F.length(col(c).cast("string"))).alias(f"l{i}") for i, c in enumerate(columns)],
        *[F.avg(is_hash_like(col(c)).cast("int")).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c
        for i, c in enumerate(columns)
        if row[f"l{i}"] is not None and row[f"l{i}"] >= 16 and row[f"m{i}"] >= 0.9
    }


# Why a column identifies rows: (reason, test of its tally and of whether its values look like hashes).
ID_RULES = (
    ("name_and_unique", lambda c, hashed: c.unique_ratio >= ID_RATIO and looks_like_id(c.name)),
    ("numeric_unique", lambda c, hashed: c.unique_ratio >= UNIQUE_RATIO and c.numeric),
    ("hash_like", lambda c, hashed: hashed),
)


def id_reasons(df: DataFrame, tally: TableTally | None = None) -> dict[str, str]:
    """H1: the columns that identify rows, each with the first rule that holds. Values are read only of unique texts
    that no rule on the tally settles."""
    tally = tally or collect_tally(df)
    why = {c.name: next((reason for reason, holds in ID_RULES if holds(c, False)), None) for c in tally.columns}
    texts = [c.name for c in tally.columns if not why[c.name] and c.kind == CATEGORICAL and c.unique_ratio >= UNIQUE_RATIO]
    why.update(dict.fromkeys(hash_like_columns(df, texts), ID_RULES[-1][0]))
    return {name: reason for name, reason in why.items() if reason}


def id_columns_frame(df: DataFrame, tally: TableTally | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame(list(id_reasons(df, tally).items()), "column string, reason string")


def detect_problem_type(df: DataFrame, target: str | None = None, tally: TableTally | None = None) -> ProblemType:
    """H3: from the target's distinct count; without a target a datetime column means a time series."""
    if not target or target not in df.columns:
        return ProblemType.TIME_SERIES if columns_of(df, DATETIME) else ProblemType.CLUSTERING
    if kind_of(df.schema[target].dataType) == BOOLEAN:
        return ProblemType.CLASSIFICATION
    one = tally[target] if tally and target in tally else collect_tally(df.select(col(target)))[target]
    return ProblemType.CLASSIFICATION if one.n_unique <= 20 else ProblemType.REGRESSION


def recommended_type(c: ColumnTally) -> ProblemType:
    """H4: the recommender's own, wider notion of a regression target."""
    if c.numeric and (c.n_unique > 20 or c.unique_ratio > 0.05):
        return ProblemType.REGRESSION
    return ProblemType.CLASSIFICATION


# What speaks for a column as the target. Of each group the first rule that holds counts: (reason, points, test of
# the tally and of how many columns come after it). Points are fixed values.
TARGET_RULES = (
    (("name_hint", 0.35, lambda c, after: any(h in c.name.lower() for h in TARGET_HINTS)),),
    (("last_column", 0.10, lambda c, after: after == 0), ("near_last", 0.04, lambda c, after: after < 3)),
    (
        ("few_categories", 0.30, lambda c, after: not c.numeric and c.n_unique <= 15),
        ("few_numbers", 0.20, lambda c, after: c.numeric and c.n_unique <= 20),
        ("continuous", 0.15, lambda c, after: c.numeric and c.unique_ratio > 0.05),
    ),
    (("low_cardinality", 0.05, lambda c, after: c.n_unique in range(2, 6)),),
    (("many_missing", -0.20, lambda c, after: c.missing_ratio > 0.30),),
)
# A column with a larger share of missing values is no target.
TARGET_MISSING = 0.60


def rank_targets(
    df: DataFrame, chosen: str | None = None, tally: TableTally | None = None, k: int = 5
) -> list[Ranked]:
    """H5/K4: the ``k`` columns with most points; a target that the user has chosen stands alone with score 1."""
    tally = tally or collect_tally(df)
    if chosen and chosen in tally:
        return [Ranked(chosen, recommended_type(tally[chosen]), 1.0, ("user_choice",))]
    ranked = []
    for after, c in zip(range(len(tally.columns) - 1, -1, -1), tally.columns):
        met = [next((r for r in group if r[2](c, after)), None) for group in TARGET_RULES]
        points = sum(r[1] for r in met if r)
        if points > 0 and c.missing_ratio <= TARGET_MISSING:
            ranked.append(Ranked(c.name, recommended_type(c), round(points, 3), tuple(r[0] for r in met if r)))
    return sorted(ranked, key=lambda r: -r.score)[:k]


def target_frame(df: DataFrame, user_target: str | None = None, tally: TableTally | None = None) -> DataFrame:
    rows = [
        (i + 1, s.column, s.problem_type.value, s.score, ",".join(s.reasons))
        for i, s in enumerate(rank_targets(df, user_target, tally))
    ]
    return df.sparkSession.createDataFrame(
        rows, "rank int, column string, problem_type string, score double, reasons string"
    )


# Why a column is of no use: (reason, test of its tally, of the number of rows and of its kind).
DROP_RULES = (
    ("nested", lambda c, rows, kind: kind == NESTED),
    ("constant", lambda c, rows, kind: c.n_unique <= 1),
    ("unique_per_row", lambda c, rows, kind: c.numeric and c.n_unique >= max(rows, 1)),
    ("mostly_missing", lambda c, rows, kind: c.missing_ratio > 0.95),
)
# How the columns that stay are filled and coded: the first rule that holds. (test, value); fixed values.
FILL_RULES = (
    (lambda c: not c.numeric, "most_frequent"),
    (lambda c: c.n_missing, "median"),
    (lambda c: True, "none"),
)
CODE_RULES = (
    (lambda c: c.numeric and 2 < c.n_unique <= 10, "ordinal"),
    (lambda c: c.numeric, "passthrough"),
    (lambda c: c.n_unique <= 10, "onehot"),
    (lambda c: True, "wide"),
)


def _first(rules, *about):
    return next((value for value, holds in rules if holds(*about)), None)


def suggest_plan(df: DataFrame, target: str | None = None, tally: TableTally | None = None) -> Plan:
    """H9: what to drop, impute, encode, scale, reduce and derive."""
    tally = tally or collect_tally(df)
    kinds = {c: kind_of(f.dataType) for c, f in zip(df.columns, df.schema.fields)}
    drop = {c: why for c, why in id_reasons(df, tally).items() if c != target}
    asked = [c for c in tally.columns if c.name != target and c.name not in drop]
    drop |= {c.name: why for c in asked if (why := _first(DROP_RULES, c, tally.n_rows, kinds[c.name]))}
    kept = [c for c in asked if c.name not in drop]
    wide = {"wide": "target" if target else "ordinal"}
    codes = {c.name: next(code for holds, code in CODE_RULES if holds(c)) for c in kept}
    numbers = [c for c in numeric_columns(df) if c not in drop and c != target]
    many = len(df.columns) - len(drop) > 50 and tally.n_rows > 500
    return Plan(
        drop=drop,
        imputation={c.name: next(how for holds, how in FILL_RULES if holds(c)) for c in kept},
        encoders={c: wide.get(code, code) for c, code in codes.items()},
        scaling="standard" if numbers else "none",
        reduction="variance" if many else None,
        date_features=tuple(columns_of(df, DATETIME)),
        ratios=len(numbers) >= 3,
        notes={c.name: "high_cardinality" for c in kept if not c.numeric and c.n_unique > 50},
    )


def plan_frame(df: DataFrame, plan: Plan) -> DataFrame:
    """The plan as rows: (column, action, value)."""
    rows = [(c, "drop", reason) for c, reason in plan.drop.items()]
    rows += [(c, "impute", how) for c, how in plan.imputation.items()]
    rows += [(c, "encode", how) for c, how in plan.encoders.items()]
    rows += [(c, "note", note) for c, note in plan.notes.items()]
    rows.append((None, "scale", plan.scaling))
    if plan.reduction:
        rows.append((None, "reduce", plan.reduction))
    rows += [(c, "feature", "date_features") for c in plan.date_features]
    if plan.ratios:
        rows.append((None, "feature", "ratios"))
    return df.sparkSession.createDataFrame(rows, "column string, action string, value string")


def propose_features(df: DataFrame, target: str | None = None, top_k: int = 3) -> DataFrame:
    """(kind, a, b, value): products of strongly correlated pairs, degree-2 terms, target bins."""
    numbers = numeric_columns(df)
    schema = "kind string, a string, b string, value double"
    rows: list[tuple] = []
    if len(numbers) >= 2:
        rows += [
            ("product", r.a, r.b, abs(r["corr"]))
            for r in top_pairs(df, numbers, top_k).collect()
            if abs(r["corr"]) >= 0.6
        ]
        if len(numbers) <= 5 and df.count() >= 200:
            rows.append(("degree_2", None, None, None))
        if target in plan_numeric_columns(df):
            rows.append(("target_quantile_bins", target, None, None))
        rows = rows or [("none", None, None, None)]
    return df.sparkSession.createDataFrame(rows, schema)


def cast_target_text(df: DataFrame, target: str):
    """The target as class text: missing is a class of its own."""
    c = as_double(df, target) if df.schema[target].dataType.simpleString() in ("float", "double") else col(target)
    return F.coalesce(c.cast("string"), F.lit("__missing__"))
