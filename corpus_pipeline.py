"""A corpus pipeline: each stage reads what its predecessor kept and hands on the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import first_of_each, with_ids
from tabloom.llm.decontaminate import split_items, with_leaks
from tabloom.llm.langid import UNKNOWN, fit, with_language
from tabloom.llm.minhash import near_duplicates
from tabloom.llm.mixing import with_copies
from tabloom.llm.passages import repeated_passages, without_passages
from tabloom.session import scratch_path, ship, written

# The least posterior probability of a document's language.
LANGUAGE_SCORE = 0.5
# Words of a shingle, and the least likeness in percent, of near duplicates.
NEAR_WIDTH, NEAR_PERCENT = 5, 80

# No SQL says character models, and the stages build on each other; the tests hold the rows against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts, texts without letters and undecided ones go.

    Rows are judged one by one, so copies and rows with equal or null ids fare alike.
    """
    judged = with_language(docs, fit(docs, F.lit(True)), lang_column="__lang", score_column="__score")
    return judged.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LANGUAGE_SCORE)).drop("__lang", "__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Texts without words are in no group and stay. Of rows with one id one stays, whose text has the smallest hash; rows
    with a null id all stay.
    """
    gone = written(near_duplicates(docs, percent=NEAR_PERCENT, width=NEAR_WIDTH).filter("not kept").select("doc_id").distinct(), "gone")
    return first_of_each(with_ids(docs, gone, "doc_id", "left_anti"), "doc_id")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are taken out; documents left without a word go.

    Rows with a null id lose nothing; rows with one id lose their own passages each. ``docs`` needs a column
    ``n_chars``, which then counts the characters left.
    """
    cut = without_passages(docs, written(repeated_passages(docs), "passages"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, whatever their ids."""
    items = split_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return with_leaks(docs, items, "__leaks").filter("__leaks = 0").drop("__leaks")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (``copies``); null sources are one source, null texts are empty."""
    return with_copies(docs, "copies").filter("copies > 0")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again, so that a lost executor costs at most a stage."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
