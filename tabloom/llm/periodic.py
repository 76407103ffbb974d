"""Periodic runs of words: stretches that repeat with a period, found by minimizers at several scales.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
``max(MIN_WORDS, 2 * q)`` words long, that no neighbouring word extends keeping the period.

Periods up to ``SCANNED`` are found by direct lag scans. Longer ones are searched scale by scale, a scale being the
periods from q to 2q - 1. There the smallest hash in each window of grams repeats one period later, so two equal minima
at a distance of the scale seed an extension, word by word to both sides. Grams that are periodic themselves would
repeat everywhere; of these only the ends of the shorter run that holds them seed, and neighbouring shorter runs whose
words go on alike. Every run has such a seed, so none is missed, and no seed counts before its words are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix, slices

MIN_WORDS = 12
# Periods up to this are compared directly; half of it must not be below MIN_WORDS, so that periodic grams lie in runs.
SCANNED = 31
_BYTES = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _over(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over all windows of ``width`` values, doubling the windows."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _powers(factor: int, n: int) -> np.ndarray:
    steps = np.full(n, factor, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class _Grams:
    """Hashes of all stretches of a text by sums of powers; equal stretches have equal hashes."""

    def __init__(self, words: np.ndarray):
        self.down = _powers(_INVERSE, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(words)), out=self.sums[1:])

    def of(self, width: int) -> np.ndarray:
        grams = (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]
        return np.maximum(mix(grams), np.uint64(1))

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        return (self.sums[places + width] - self.sums[places]) * self.down[places]


def _scan(words: np.ndarray, period: int) -> np.ndarray:
    """(start, length, period) of the maximal stretches with a period that are long enough."""
    same = np.flatnonzero(words[:-period] == words[period:])
    if not len(same):
        return np.zeros((0, 3), np.int64)
    cuts = np.flatnonzero(np.diff(same) != 1)
    first, last = same[np.concatenate([[0], cuts + 1])], same[np.concatenate([cuts, [len(same) - 1]])]
    length = last - first + 1 + period
    keep = length >= max(MIN_WORDS, 2 * period)
    return np.stack([first[keep], length[keep], np.full(int(keep.sum()), period)], axis=1)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of equal stretches that with the smallest period, in order; the longer periods are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _pairs(places: np.ndarray, marks: np.ndarray, scale: int) -> list[tuple[int, int]]:
    """(distance, place) of all pairs with equal marks at a distance of the scale."""
    order = np.lexsort((places, marks))
    places, marks = places[order], marks[order]
    found: list[tuple[int, int]] = []
    for step in range(1, len(places)):
        far = places[step:] - places[:-step]
        near = (marks[step:] == marks[:-step]) & (far < 2 * scale)
        if not near.any():
            break
        near &= far >= scale
        found += zip(far[near].tolist(), places[:-step][near].tolist())
    return found


def _reach(words: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """How many words from a and b on, in steps of 1 or -1 and at most ``limit``, are the same."""
    done, size = 0, 64
    while done < limit:
        n = min(size, limit - done)
        if step > 0:
            same = words[a + done : a + done + n] == words[b + done : b + done + n]
        else:
            same = (words[a - done - n + 1 : a - done + 1] == words[b - done - n + 1 : b - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, size = done + n, 2 * size
    return done


def _neighbours(runs: np.ndarray, row: np.ndarray, grams: _Grams, scale: int) -> list[tuple[int, int]]:
    """Seeds for two runs of one period that touch: all distances at which the second goes on as the first."""
    found = []
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2], row[runs[:, 0]]))]
    ends = runs[:, 0] + runs[:, 1]
    touch = (row[runs[1:, 0]] == row[runs[:-1, 0]]) & (runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= ends[:-1])
    for i in np.flatnonzero(touch).tolist():
        (s1, _, p), (s2, _, _), e1, e2 = runs[i].tolist(), runs[i + 1].tolist(), int(ends[i]), int(ends[i + 1])
        hit = np.flatnonzero(grams.at(np.arange(s2, s2 + p), p) == grams.at(np.array([e1 - p]), p))
        for phase in hit.tolist():
            shift = s2 + phase - (e1 - p)
            for q in range(scale + (shift - scale) % p, 2 * scale, p):
                start = max(s1, s2 - q)
                if min(e1, e2 - q) - start >= q:
                    found.append((q, start))
    return found


def _at_scale(words: np.ndarray, row: np.ndarray, bounds: np.ndarray, grams: _Grams, known: np.ndarray, scale: int) -> np.ndarray:
    """Runs with periods of one scale; ``known`` are those with shorter ones."""
    size = (scale + 1) // 2
    hashes = grams.of(size)
    short = known[(known[:, 2] <= size // 2) & (known[:, 1] >= size)]
    least = _over(hashes, size, np.minimum)
    least[row[: len(least)] != row[2 * size - 2 :]] = 0
    pad = np.zeros(size - 1, np.uint64)
    chosen = _over(np.concatenate([pad, least, pad]), size, np.maximum) == hashes
    if len(short):
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, short[:, 0], 1)
        np.subtract.at(depth, short[:, 0] + short[:, 1] - size + 1, 1)
        chosen &= np.cumsum(depth[:-1]) == 0
    places = np.flatnonzero(chosen)
    seeds = _pairs(places, hashes[places], scale)
    if len(short):
        for ends in (short[:, 0], short[:, 0] + short[:, 1] - size):
            seeds += _pairs(ends, mix(hashes[ends] + short[:, 2].astype(np.uint64)), scale)
        seeds += _neighbours(short, row, grams, scale)
    found, last, upto = [], -1, -1
    for period, place in sorted(seeds):
        low, high = int(bounds[row[place]]), int(bounds[row[place] + 1])
        if place + period >= high or (period == last and place < upto):
            continue
        ahead = _reach(words, place, place + period, high - place - period, 1)
        back = _reach(words, place - 1, place - 1 + period, place - low, -1)
        last, upto = period, place + ahead
        if ahead + back >= period:
            found.append((place - back, ahead + back + period, period))
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of several texts, in order; starts count over all texts.

    ``codes`` are numbers of words, equal where the words are; ``bounds`` the first word of each text, and the end.
    """
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    words = codes + row * (codes.max(initial=0) + 1)
    runs = np.zeros((0, 3), np.int64)
    for period in range(1, min(SCANNED, len(words) - 1) + 1):
        runs = np.concatenate([runs, _scan(words, period)])
    runs = _smallest(runs)
    scale, shift = SCANNED + 1, np.zeros(len(bounds) - 1, np.int64)
    while True:
        # Texts too short for the scale are left out.
        sizes = np.diff(bounds)
        long = sizes >= 2 * scale
        if not long.any():
            return _smallest(runs)
        if not long.all() or scale == SCANNED + 1:
            kept = long[row]
            inside = np.cumsum(np.concatenate([[0], np.where(long, 0, sizes)]))[:-1]
            shift = (shift + inside)[long]
            words, bounds = words[kept], np.concatenate([[0], np.cumsum(sizes[long])])
            row = np.repeat(np.arange(len(bounds) - 1), sizes[long])
            grams = _Grams(words)
        starts = bounds[:-1] + shift
        owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
        here = (owner >= 0) & (runs[:, 0] < (bounds[1:] + shift)[owner])
        known = runs[here] - np.stack([shift[owner[here]], *np.zeros((2, int(here.sum())), np.int64)], axis=1)
        new = _at_scale(words, row, bounds, grams, known, scale)
        if len(new):
            new[:, 0] += shift[row[new[:, 0]]]
            runs = _smallest(np.concatenate([runs, new]))
        scale *= 2


def _texts(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, their numbers, and the first word of each text."""
    words: list[bytes] = []
    bounds = [0]
    for text in texts.to_pylist():
        if text:
            words += _WORD.findall(text.encode())
        bounds.append(len(words))
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return words, codes, np.array(bounds, np.int64)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", _BYTES):
            words, codes, bounds = _texts(part.column("text"))
            runs = runs_of(codes, bounds)
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
            np.subtract.at(depth, runs[:, 0] + runs[:, 1], 1)
            keep = (np.cumsum(depth[:-1]) == 0).tolist()
            ends = bounds.tolist()
            left = [b" ".join(compress(words[a:b], keep[a:b])).decode() for a, b in zip(ends, ends[1:])]
            first = np.searchsorted(runs[:, 0], bounds)
            owner = np.searchsorted(first, np.arange(len(runs)), side="right") - 1
            columns = [runs[:, 0] - bounds[owner], runs[:, 1], runs[:, 2]]
            told = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), told),
                    pa.array(left, pa.string()),
                ],
                names=["id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: its runs by start and period, and its text without repetitions.

    Words are runs of bytes other than white space, compared as they are. ``collapsed`` are the words that no run
    holds after its first period, joined by one space. A null, empty or blank text has no words, no runs and an empty
    ``collapsed``; rows with equal or null ids are taken one by one; other columns are not read; an empty table gives
    an empty result. Texts are never cut or moved: each is read whole by the task that scans it.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    lean = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return lean.mapInArrow(_find, f"id {kind}, n_words bigint, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_column)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, of several the first, then that with the smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    one = F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))
    return F.when(best.isNotNull(), one)


def with_repeated_tail(text: Column, seed: Column) -> Column:
    """The words of a text joined by one space, the tail repeating its first words where ``seed`` says so.

    With h = ``seed``, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, each word i >= a is the original word
    a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts stay as they are.
    """
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g = F.floor(seed / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

        def place(of: Column) -> Column:
            at = lambda i: F.when(i < of["a"], i).otherwise(of["a"] + (i - of["a"]) % of["p"])
            return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i).cast("int"))), " ")

        return F.get(F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), place), F.lit(0))

    # The array of one holds the words, so that they are split once.
    tail = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), F.lit(0))
    return F.when(seed % 10 == 0, tail).otherwise(text)
