"""Word and shingle hashes of Arrow text columns, computed over whole batches of UTF-8 bytes.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r`` with A-Z lower-cased. Hashes are 64 bits wide
and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes hashed at a time; longer only where a single word is longer.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, extended on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_slice(part: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a slice; ``first`` marks where rows begin."""
    gap = (part == 32) | ((part >= 9) & (part <= 13))
    edge = np.ones(len(part) + 1, bool)
    edge[1:-1] = gap[1:] | gap[:-1] | first[1:]
    starts = np.flatnonzero(~gap & edge[:-1])
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    up, down = _POWERS.upto(len(part) + 1)
    low = part + ((part >= 65) & (part <= 90)) * np.uint8(32)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE
    return mix(hashes), starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte start, byte end) of every word, and the index of the first word of each row (one more at the end)."""
    found, n, at = [], len(data), 0
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    while at < n:
        to = min(n, at + SLICE)
        if to < n:
            back = data[at:to]
            cuts = np.flatnonzero((back == 32) | ((back >= 9) & (back <= 13)) | first[at + 1 : to + 1])
            if len(cuts):
                to = at + int(cuts[-1]) + 1
            else:  # a single long word
                rest = data[to:]
                ahead = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13)) | first[to + 1 : n + 1])
                to = to + int(ahead[0]) + 1 if len(ahead) else n
        hashes, starts, ends = _hash_slice(data[at:to], first[at:to])
        found.append((hashes, starts + at, ends + at))
        at = to
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found)) if found else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside rows, in order, and the bounds of the rows among them."""
    sizes = np.maximum(np.diff(bounds) - width + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    if len(words) < width:
        return np.zeros(0, np.uint64), out_bounds
    total = words[: len(words) - width + 1].copy()
    for i in range(1, width):
        total = mix(total * np.uint64(0x100000001B3) + words[i : len(words) - width + 1 + i])
    room = np.zeros(len(words) + 1, np.int32)
    room[bounds[:-1][sizes > 0]] += 1
    np.subtract.at(room, bounds[:-1][sizes > 0] + sizes[sizes > 0], 1)
    inside = np.cumsum(room[: len(total)]) > 0
    return mix(total[inside]), out_bounds


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text each, or one row."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
