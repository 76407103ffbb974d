"""Document fingerprints by consistent weighted sampling.

A text is its words weighted by their counts. Each of the samples draws one (word, level) with gamma variables that
depend on the word alone (Ioffe, 2010); two texts agree in a sample with a chance equal to the generalised Jaccard
similarity of their weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .words import buffers, mix, slices, word_hashes

SAMPLES = 64
# Characters fingerprinted at a time, or one document; each word is drawn once for all of them.
_SLICE = 4 << 20


def _uniforms(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) of 23 bits each."""
    low = (bits >> np.uint64(18)) & np.uint64((1 << 23) - 1)
    return tuple((b.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23) for b in (bits >> np.uint64(41), low))


def _draws(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, log c, beta) of each word for sample ``k``: r and c are Gamma(2, 1), beta is uniform."""
    seed = mix(words + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    a, b = _uniforms(mix(seed ^ np.uint64(0x5BD1E995)))
    c, d = _uniforms(mix(seed ^ np.uint64(0xC2B2AE35)))
    return -np.log(a * b), np.log(-np.log(c * d)), _uniforms(seed)[0]


def _sortable(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers as integers in the same order, in the upper half of 64 bits."""
    bits = x.view(np.uint32)
    flipped = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    return flipped.astype(np.uint64) << np.uint64(32)


def weighted_samples(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """One row of 32-bit samples for each text of a slice; a text without words has zeros."""
    words, _, _, bounds = word_hashes(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, samples), np.uint32)
    if not len(words):
        return out
    row = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])]))
    counts = np.diff(np.append(new, len(words)))
    words, row = words[new], row[new]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    unique, where = np.unique(words, return_inverse=True)
    often = np.flatnonzero(counts > 1)
    weight, of_often = np.log(counts[often].astype(np.float32)), where[often]
    names = np.concatenate([unique, unique[of_often]])
    levels = np.zeros(len(names), np.int64)
    place = np.arange(len(names), dtype=np.uint64)
    for k in range(samples):
        r, c, beta = _draws(unique, k)
        # A word that occurs once is on level 0; its value does not depend on the text.
        keys = (_sortable(c + r * beta - r) | place[: len(unique)])[where]
        r, c, beta = r[of_often], c[of_often], beta[of_often]
        level = np.floor(weight / r + beta)
        levels[len(unique) :] = level
        keys[often] = _sortable(c - r * (level - beta) - r) | place[len(unique) :]
        won = (np.minimum.reduceat(keys, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        mark = mix(names[won] + levels[won].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out[row[starts], k] = (mark >> np.uint64(32)).astype(np.uint32)
    return out


def _fingerprints(texts: list[bytes], samples: int) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    return weighted_samples(data, np.concatenate([[0], np.cumsum(sizes)]), samples)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u4").tobytes().hex() for r in rows]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples that agree: an unbiased estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1) if a.shape[1] else np.ones(len(a))


def fingerprint_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) of each whole text: ``samples`` times 8 hex digits, zeros for a null text or one without
    words. Rows are taken one by one; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = _hex(weighted_samples(*buffers(part.column("text")), samples))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.string())], names=["id", "fingerprint"])

    lean = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return lean.mapInArrow(run, f"id {lean.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_column)


def _range_of(ends: list[int], at: Column) -> Column:
    """The number of ends above ``at``, by halving: ranges in descending order."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(at >= ends[mid], half(low, mid)).otherwise(half(mid + 1, high))

    return half(0, len(ends))


_OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _walk(samples: int):
    """Fingerprint the rows of each range in their order, each with its successor in front of it."""

    def finish(rows: list[tuple], after: tuple) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        following = [*texts[1:], after[1]]
        edited = []
        for text, nxt in zip(texts, following):
            k = len(text) // 3
            edited.append((text[: len(text) - k] + nxt[:k]).encode())
        both = _fingerprints([*(t.encode() for t in [*texts, after[1]]), *edited], samples)
        own, changed = both[: len(rows) + 1], both[len(rows) + 1 :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                pa.array(_hex(own[:-1]), pa.string()),
                pa.array(_hex(changed), pa.string()),
                pa.array(likeness(own[:-1], changed), pa.float64()),
                pa.array(likeness(own[:-1], own[1:]), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        place = None
        for batch in batches:
            for at, key, text, is_guest in zip(*(batch.column(c).to_pylist() for c in ("range", "id", "text", "guest"))):
                row = (key, text or "")
                if at != place and held:  # the last row of a range is a guest, kept only as a successor
                    held, size = [], 0
                place = at
                held.append(row)
                size += len(row[1])
                if len(held) > 1 and (is_guest or size > _SLICE):
                    yield finish(held[:-1], held[-1])
                    held, size = ([], 0) if is_guest else ([row], len(row[1]))

    return walk


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third comes from the next document.

    The next document follows in descending order of the id, nulls last, equal ids by the hash of their texts; after
    the last comes the first. The last floor(n_chars / 3) code points are replaced by the first as many of the next
    text, or all of it. ``near_edited`` and ``near_next`` are the likeness of the fingerprint to the edit's and to
    the next document's. A null text is empty; texts without words are all alike. A single document is its own
    next one; an empty table gives an empty result; other columns are not read.
    """
    lean = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    n_ranges = partitions(docs)
    ends = lean.select("id").approxQuantile("id", [i / n_ranges for i in range(1, n_ranges)], 0.25 / n_ranges)
    ends = sorted({int(e) for e in ends}, reverse=True)
    lowest = F.lit(len(ends))
    placed = lean.withColumn("range", F.when(F.col("id").isNull(), lowest).otherwise(_range_of(ends, F.col("id"))) if ends else F.lit(0))
    # The first document of each range is also the guest at the end of the range before it.
    order = F.struct(F.col("id").isNotNull().alias("some"), "id", "tie")
    heads = sorted(placed.groupBy("range").agg(F.max(order).alias("head")).collect(), key=lambda r: r["range"])
    if not heads:
        return docs.sparkSession.createDataFrame([], _OUT.replace("doc_id", id_column))
    guests = None
    for i, r in enumerate(heads):
        before = heads[i - 1]["range"]
        mine = (F.col("tie") == r.head.tie) & (F.col("id").eqNullSafe(F.lit(r.head.id)))
        guests = F.when(mine, before) if guests is None else guests.when(mine, before)
    keys = [r.head.id for r in heads]
    few = placed.filter(F.col("id").isin([k for k in keys if k is not None]) | (F.col("id").isNull() if None in keys else F.lit(False)))
    guest_rows = few.withColumn("range", guests).filter("range is not null").dropDuplicates(["range"])
    both = placed.withColumn("guest", F.lit(False)).unionByName(guest_rows.withColumn("guest", F.lit(True)))
    return (
        both.repartitionByRange(len(heads), "range")
        .sortWithinPartitions("range", "guest", F.desc_nulls_last("id"), F.desc("tie"))
        .select("range", "id", "text", "guest")
        .mapInArrow(_walk(samples), _OUT)
        .withColumnRenamed("doc_id", id_column)
    )
