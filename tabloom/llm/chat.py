"""Preference pairs as training text: the common turns of two conversations once as the prompt, the rest as two
completions whose trained parts are marked. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ANSWERS = "assistant"


def conversations(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id, turns): the turns of each conversation as (role, text), in the order of the turn, then role and text.

    Null roles and texts are empty. Turns with a null id belong to no conversation and are left out. A conversation
    is one value, so it must fit an executor, as its rendered text must.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def last_answer_swapped(turns: Column) -> Column:
    """A rejected conversation: the last answer gives way to the answer before it, or to an empty one. Without any
    answer the last turn is left out."""
    at = F.transform(turns, lambda t, i: F.when(t["role"] == ANSWERS, i))
    answers = F.filter(at, lambda i: i.isNotNull())
    n = F.size(answers)
    last = F.when(n > 0, F.element_at(answers, -1))
    before = F.when(n > 1, F.element_at(answers, -2))
    text = F.coalesce(F.get(turns, before)["text"], F.lit(""))
    swapped = F.transform(
        turns, lambda t, i: F.when(i == last, F.struct(t["role"].alias("role"), text.alias("text"))).otherwise(t)
    )
    return F.when(n > 0, swapped).otherwise(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))))


def common_turns(a: Column, b: Column) -> Column:
    """The number of turns at the front that two conversations share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.least(F.size(a), F.size(b), F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def trained_spans(turns: Column) -> Column:
    """``start-stop`` of each answer with its end mark, in characters of the rendered turns, joined by commas."""

    def add(done: Column, turn: Column) -> Column:
        start = done["at"] + len(START) + 1 + F.length(turn["role"])
        span = F.concat(start.cast("string"), F.lit("-"), (start + F.length(turn["text"]) + len(END)).cast("string"))
        return F.struct(
            (done["at"] + F.length(_rendered(turn))).alias("at"),
            F.when(turn["role"] == ANSWERS, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, add)["spans"], ",")


def format_preferences(pairs: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) of (id, chosen, rejected).

    ``chosen`` and ``rejected`` are arrays of (role, text) without null elements. The longest run of equal turns at
    the front is rendered once as the prompt; the turns after it are the completions. Nothing of the prompt is
    trained on, of a completion only the spans of its answers. Equal conversations have empty completions; a null
    conversation is an empty one; texts are not escaped; rows are formatted one by one and other columns left out.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select(
        F.col(id_column), F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected")
    ).withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    n = F.col("n_prompt_turns")

    def rest(c: str) -> Column:
        return F.slice(c, n + 1, F.size(c) - n)

    return both.select(
        id_column, "n_prompt_turns",
        render(F.slice("chosen", F.lit(1), n)).alias("prompt"),
        render(rest("chosen")).alias("chosen"), render(rest("rejected")).alias("rejected"),
        trained_spans(rest("chosen")).alias("chosen_spans"), trained_spans(rest("rejected")).alias("rejected_spans"),
    )
