"""Questions answered from the facet that knows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import drop_columns, numeric_columns, plan_numeric_columns
from ..operators.correlation import top_pairs
from ..operators.profile import duplicate_count, missing, outliers, target_summary, target_top_values, top_missing
from ..operators.tally import collect_tally
from .heuristics import id_reasons

# The words that route a question, first match wins. All words of one inner tuple must occur.
KEYWORDS: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("rows", (("combien de lignes",), ("taille du dataset",), ("nombre d'observations",))),
    ("columns", (("combien de colonnes",), ("variables",), ("features",))),
    ("missing", (("manquante",), ("nan",))),
    ("duplicates", (("doublon",),)),
    ("correlations", (("corr",), ("corrél",))),
    ("best_model", (("meilleur modèle",), ("best model",), ("leaderboard",), ("comparer",))),
    ("target", (("cible",), ("target",))),
    ("outliers", (("outlier",),)),
    ("drop_columns", (("supprimer", "colonne"),)),
    ("importance", (("influence",), ("important",))),
)

ANSWER_SCHEMA = "topic string, item string, value double"


def topic_of(question: str) -> str:
    """which branch answers the question."""
    text = question.lower().strip()
    if not text:
        return "empty"
    for topic, choices in KEYWORDS:
        if any(all(word in text for word in words) for words in choices):
            return topic
    return "unknown"


def _answer(topic: str, df: DataFrame, item: Column, value: Column) -> DataFrame:
    return df.select(F.lit(topic).alias("topic"), item.cast("string").alias("item"), value.cast("double").alias("value"))


def _fixed(df: DataFrame, topic: str, *rows: tuple[str | None, float | None]) -> DataFrame:
    return df.sparkSession.createDataFrame([(topic, *r) for r in rows], ANSWER_SCHEMA)


def ask(
    df: DataFrame,
    question: str,
    target: str | None = None,
    board: DataFrame | None = None,
    importance: DataFrame | None = None,
) -> DataFrame:
    """(topic, item, value). An answer computes the facet it needs; no rows mean there is none."""
    topic = topic_of(question)
    return _ANSWERS.get(topic, lambda d, *_: _fixed(d, topic))(df, target, board, importance)


def _rows(df, *_):
    return _answer("rows", df.agg(F.count(F.lit(1)).alias("n")), F.lit("rows"), F.col("n")).unionByName(
        _fixed(df, "rows", ("columns", float(len(df.columns))))
    )


def _columns(df, *_):
    return _fixed(
        df, "columns", ("columns", float(len(df.columns))), ("numeric", float(len(numeric_columns(df))))
    )


def _missing(df, *_):
    return _answer("missing", top_missing(df, 5), F.col("column"), F.col("n_missing"))


def _duplicates(df, *_):
    return _answer("duplicates", duplicate_count(df), F.lit("duplicates"), F.col("n_duplicates"))


def _correlations(df, *_):
    pairs = top_pairs(df, k=3)
    return _answer("correlations", pairs, F.concat_ws(",", "a", "b"), F.abs("corr"))


def _best_model(df, target, board, importance):
    if board is None:
        return _fixed(df, "best_model")
    return _answer("best_model", board.orderBy("rank").limit(1), F.col("name"), F.col("score"))


def _target(df, target, *_):
    if not target or target not in df.columns:
        return _fixed(df, "target")
    if target in plan_numeric_columns(df) and collect_tally(df.select(f"`{target}`"))[target].n_unique > 20:
        row = target_summary(df, target)
        parts = F.explode(
            F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("mean", "median", "std")])
        )
        return _answer("target", row.select(parts.alias("p")), F.col("p.item"), F.col("p.value"))
    return _answer("target", target_top_values(df, target, 5), F.col("value"), F.col("n"))


def _outliers(df, *_):
    analysed = drop_columns(df, list(id_reasons(df)))
    first = outliers(analysed).orderBy("position").limit(5)
    return _answer("outliers", first, F.col("column"), F.col("n_outliers"))


def _drop_columns(df, *_):
    worst = missing(df).orderBy(F.desc("n_missing"), "position").limit(1).filter(F.col("ratio") > 0.4)
    return _answer("drop_columns", worst, F.col("column"), F.col("ratio"))


def _importance(df, target, board, importance):
    if importance is None:
        return _fixed(df, "importance")
    top = importance.orderBy(F.desc("importance"), "feature").limit(5)
    return _answer("importance", top, F.col("feature"), F.col("importance"))


_ANSWERS: dict[str, Callable[..., DataFrame]] = {
    "rows": _rows,
    "columns": _columns,
    "missing": _missing,
    "duplicates": _duplicates,
    "correlations": _correlations,
    "best_model": _best_model,
    "target": _target,
    "outliers": _outliers,
    "drop_columns": _drop_columns,
    "importance": _importance,
}
