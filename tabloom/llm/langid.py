"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .words import buffers, mix, slices

# Pairs and triples of characters fall into so many buckets.
BUCKETS = 1 << 15
# The model learns from about so many labelled documents of each language, chosen by a hash of their texts.
FIT_PER_LANG = 3_000
# The matrix that is broadcast: BUCKETS single-precision numbers for each language.
MATRIX_BYTES = 256 << 20
_BYTES = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point the first code point of its lower case where it is a letter, else 32."""
    table = np.full(sys.maxunicode + 1, 32, np.int32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all rows (a row begins with a space, runs of other characters are one) and the rows' bounds."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.cumsum((data & 0xC0) != 0x80)
    starts = np.concatenate([[0], lead])[offsets]
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    letters = _letters()[points]
    keep = letters != 32
    keep[1:] |= letters[:-1] != 32
    keep[starts[:-1][np.diff(starts) > 0]] = True
    letters, row_of = letters[keep], row_of[keep]
    # A space in front of each row that begins with a letter.
    first = np.ones(len(row_of), bool)
    first[1:] = row_of[1:] != row_of[:-1]
    add = np.flatnonzero(first & (letters != 32))
    letters, row_of = np.insert(letters, add, 32), np.insert(row_of, add, row_of[add])
    return letters, np.searchsorted(row_of, np.arange(len(offsets)))


def ngram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of all hashed pairs and triples of characters, and whether a row has a letter."""
    letters, bounds = _code_points(*buffers(texts))
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    has_letter = np.bincount(row_of[letters != 32], minlength=len(bounds) - 1) > 0
    points = letters.astype(np.uint64)
    cells = []
    for n in (2, 3):
        if len(points) < n:
            continue
        total = np.full(len(points) - n + 1, n, np.uint64)
        for i in range(n):
            total = total * np.uint64(0x100000001B3) + points[i : len(points) - n + 1 + i]
        inside = row_of[: len(total)] == row_of[n - 1 :]
        bucket = (mix(total[inside]) >> np.uint64(49)).astype(np.int64)
        cells.append(row_of[: len(total)][inside] * BUCKETS + bucket)
    cell, count = np.unique(np.concatenate(cells), return_counts=True) if cells else (np.zeros(0, np.int64),) * 2
    return cell // BUCKETS, cell % BUCKETS, count, has_letter


@dataclass(frozen=True)
class Model:
    """Languages with the log probabilities of their buckets (one column each) and of themselves."""

    langs: tuple[str, ...]
    matrix: np.ndarray
    prior: np.ndarray

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The most probable language and its posterior probability for each text."""
        row, bucket, count, has_letter = ngram_counts(texts)
        total = np.zeros((len(texts), len(self.langs))) + self.prior
        for j in range(len(self.langs)):
            total[:, j] += np.bincount(row, count * self.matrix[bucket, j], minlength=len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        with np.errstate(under="ignore"):
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)]
        return langs, np.where(has_letter, np.clip(share, 0, 1), 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the bucket counts of each language in a slice of documents."""
    for batch in batches:
        for part in slices(batch, "text", _BYTES):
            langs, code = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            row, bucket, count, _ = ngram_counts(part.column("text"))
            cell, inverse = np.unique(code[row] * BUCKETS + bucket, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs[cell // BUCKETS], pa.string()), pa.array((cell % BUCKETS).astype(np.int32)),
                    pa.array(np.bincount(inverse, count, minlength=len(cell)).astype(np.int64)),
                ],
                names=["lang", "bucket", "n"],
            )


def fit(docs: DataFrame, trains: Column, per_lang: int = FIT_PER_LANG, alpha: float = 0.1) -> Model:
    """Learn from (text, lang) of the rows where ``trains`` holds and lang is not null.

    About ``per_lang`` documents of each language are used, those with the smallest hashes of their texts; a
    language with fewer uses all. The driver gets at most ``BUCKETS`` counts for each language.
    """
    labelled = docs.filter(trains & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) * BUCKETS * 4 > MATRIX_BYTES:
        raise ValueError(f"{len(sizes)} languages: their matrix would be larger than {MATRIX_BYTES} bytes")
    langs = sorted(sizes)
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    # Hashes are even over 2^20 steps, so a share of the steps is a share of the documents.
    steps = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1 << 20, -(-(per_lang << 20) // sizes[k])))])
    chosen = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < steps[F.col("lang")])
    counts = (
        chosen.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    table = np.full((BUCKETS, len(langs)), alpha)
    where = {lang: j for j, lang in enumerate(langs)}
    table[counts["bucket"].to_numpy(int), counts["lang"].map(where).to_numpy(int)] += counts["n"].to_numpy(float)
    prior = np.array([sizes[k] for k in langs], float)
    return Model(tuple(langs), np.log(table / table.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def with_language(
    docs: DataFrame, model: Model, text_column: str = "text", lang_column: str = "lang_pred", score_column: str = "score"
) -> DataFrame:
    """Add the most probable language of each whole text and its posterior probability.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Rows are judged one by
    one and keep their other columns, but for any named like the new ones; an empty table gives an empty result.
    """
    kept = docs.drop(lang_column, score_column)
    schema = StructType([*kept.schema.fields, StructField(lang_column, StringType()), StructField(score_column, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column, _BYTES):
                langs, share = model.score(part.column(text_column))
                yield part.append_column(lang_column, pa.array(langs, pa.string())).append_column(score_column, pa.array(share, pa.float64()))

    return kept.mapInArrow(score, schema)


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row as in :func:`with_language`; only the id and the text are read."""
    return with_language(docs.select(id_column, text_column), model, text_column).drop(text_column)
