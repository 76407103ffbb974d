"""Substring dedup: passages of 50 words or more that occur, nearly alike, in several documents.

A text is its sequence of five-word shingles. For each of a few hash functions, every stretch of 46 shingles or more
has one smallest hash; all stretches with the same smallest position form a compact window (left, centre, right),
which a Cartesian tree over the hashes yields: a window ends before the next smaller hash on either side. Documents
meet on the smallest hash of their windows. Windows of enough hash functions that overlap give a candidate stretch,
whose shingles are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encoders import ranked
from ..session import discard, written
from .common import BROADCAST_IDS, partitions, with_ids
from .words import buffers, mix, shingles, slices, word_hashes

WIDTH = 5
MIN_WORDS = 50
OVERLAP = 0.8
# A pair of stretches with a Jaccard likeness of 0.8 agrees in two of five hash functions with a chance of 0.993, equal
# stretches always. Replaced words that leave a share of 0.8 leave a Jaccard likeness of 0.67 (a chance of 0.95).
HASHES = 5
ENOUGH = 2
_BYTES = 1 << 20
# The same where texts are cut or only their shingles are wanted.
_LEAN_BYTES = 1 << 18
# Shingles of windows that are settled at a time, more only where one key has more.
_PART_SHINGLES = 300_000
_GATHERED = 1 << 20
# Windows of smaller ids that a window looks at first; four times as many each time that they leave something new.
_FIRST_LOOK = 64
# Bytes of text whose windows (about one for 32 bytes) come to one task.
_PART_BYTES = 64 << 20
# The least number of shingles that a passage shares.
_SHARED = -(-(MIN_WORDS - WIDTH + 1) * 8 // 10)


def _sliding(values: np.ndarray, size: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over all runs of ``size`` values, by blocks of that size."""
    n = len(values)
    blocks = np.full(-(-n // size) * size, fill, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, size)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - size + 1], ahead[size - 1 : n])


def _nearest_smaller(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest one in front that is smaller, in the same group; -1 without one.

    Each index leaps along the answers found so far, as in a walk up a Cartesian tree.
    """
    to = np.arange(-1, len(values) - 1)
    if len(values):
        to[np.concatenate([[True], group[1:] != group[:-1]])] = -1
    active = np.flatnonzero(to >= 0)
    while len(active):
        active = active[values[to[active]] >= values[active]]
        to[active] = to[to[active]]
        active = active[to[active] >= 0]
    return to


def compact_windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(row, left, centre, right, hash) of the windows of ``size`` or more; positions count over all rows.

    Equal hashes do not end a window; of those in one window the first is its centre.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    n = len(hashes)
    if n < size:
        return none
    hashes = np.maximum(hashes, np.uint64(1))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least = _sliding(hashes, size, np.minimum, np.iinfo(np.uint64).max)
    least[row[: n - size + 1] != row[size - 1 :]] = 0
    pad = np.zeros(size - 1, np.uint64)
    centre = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), size, np.maximum, 0) == hashes)
    # The next smaller hash on either side is itself the least of some stretch, so only these positions matter.
    value, owner = hashes[centre], row[centre]
    before = _nearest_smaller(value, owner)
    after = _nearest_smaller(value[::-1], owner[::-1])[::-1]
    left = np.where(before >= 0, centre[before] + 1, bounds[owner])
    right = np.where(after >= 0, centre[len(centre) - 1 - np.maximum(after, 0)] - 1, bounds[owner + 1] - 1)
    _, first = np.unique(left * np.int64(n) + right, return_index=True)
    return owner[first], left[first], centre[first], right[first], value[first]


def _shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, _, _, bounds = word_hashes(*buffers(texts))
    return shingles(words, bounds, WIDTH)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = MIN_WORDS - WIDTH + 1
    for batch in batches:
        for part in slices(batch, "text", _BYTES):
            found, bounds = _shingled(part.column("text"))
            for j in range(HASHES):
                row, left, _, right, value = compact_windows(mix(found + np.uint64((j + 1) * 0x632BE59BD9B4E019 % (1 << 64))), bounds, size)
                start = bounds[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((value & ~np.uint64(7) | np.uint64(j)).astype(np.int64)),
                        part.column("id").take(pa.array(row)),
                        *(pa.array((x - start).astype(np.int32)) for x in (left, right)),
                    ],
                    names=["key", "id", "left", "right"],
                )


def _stretches(batches: Iterator[pa.RecordBatch], least: int = ENOUGH) -> Iterator[pa.RecordBatch]:
    """Join overlapping windows of a pair of documents, of ``least`` hash functions; rows come sorted by pair and left end."""
    names = ["id", "hub", "left", "right", "hub_left", "hub_right"]

    def join(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.ones(len(x["id"]), bool)
        new[1:] = (x["id"][1:] != x["id"][:-1]) | (x["hub"][1:] != x["hub"][:-1])
        pair = np.cumsum(new)
        # The farthest right end so far in a pair; pairs are kept apart by multiples of a larger number.
        far = np.maximum.accumulate(pair * np.int64(1 << 32) + x["right"])
        new[1:] |= pair[1:] * np.int64(1 << 32) + x["left"][1:] > far[:-1]
        at = np.flatnonzero(new)
        kinds = np.bitwise_or.reduceat(np.left_shift(1, (x["key"] & 7).astype(np.int64)), at)
        enough = np.array([int(k).bit_count() for k in kinds]) >= least
        ends = {
            "id": x["id"][at], "hub": x["hub"][at],
            **{c: np.minimum.reduceat(x[c], at) for c in ("left", "hub_left")},
            **{c: np.maximum.reduceat(x[c], at) for c in ("right", "hub_right")},
        }
        return pa.RecordBatch.from_arrays([pa.array(ends[c][enough]) for c in names], names=names)

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", *names)}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        if not len(rows["id"]):
            continue
        last = (rows["id"] == rows["id"][-1]) & (rows["hub"] == rows["hub"][-1])
        held = {c: v[last] for c, v in rows.items()}
        if not last.all():
            yield join({c: v[~last] for c, v in rows.items()})
    if held is not None:
        yield join(held)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each shingle: enough to compare two stretches."""
    for batch in batches:
        for part in slices(batch, "text", _LEAN_BYTES):
            found, bounds = _shingled(part.column("text"))
            low = (found >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(low))], names=["id", "shingles"]
            )


def alike_runs(own: np.ndarray, other: np.ndarray, size: int = MIN_WORDS - WIDTH + 1, overlap: float = OVERLAP) -> list[tuple[int, int, float]]:
    """(first, last, share) of the longest runs of ``own`` of at least ``size`` that begin and end with a shingle of
    ``other`` and hold a share of at least ``overlap`` of such; then of the longest in front of and behind each."""
    return _runs_at(np.flatnonzero(np.isin(own, other)), size, overlap)


def _farthest(at: np.ndarray, overlap: float) -> np.ndarray:
    """For each of the places ``at`` the index of the last one up to which the share of places holds."""
    # From the i-th to the j-th the share holds where height[j] >= height[i] - (1 - overlap).
    height = np.arange(len(at)) - overlap * (at - at[0])
    highest_behind = np.maximum.accumulate(height[::-1])[::-1]
    return np.searchsorted(-highest_behind, -(height - (1 - overlap) - 1e-9), side="right") - 1


def _runs_at(at: np.ndarray, size: int = MIN_WORDS - WIDTH + 1, overlap: float = OVERLAP) -> list[tuple[int, int, float]]:
    found, todo = [], [at]
    while todo:
        at = todo.pop()
        if not len(at) or at[-1] - at[0] + 1 < size:
            continue
        last = _farthest(at, overlap)
        length = at[last] - at + 1
        i = int(length.argmax())
        if length[i] < size:
            continue
        j = int(last[i])
        found.append((int(at[i]), int(at[j]), (j - i + 1) / int(length[i])))
        todo += [at[:i], at[j + 1 :]]
    return sorted(found)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        ids, hubs, starts = (batch.column(c).to_pylist() for c in ("id", "hub", "left"))
        own, other = batch.column("own"), batch.column("other")
        for i in range(batch.num_rows):
            a, b = (c[i].values.to_numpy(zero_copy_only=False) for c in (own, other))
            out += [(ids[i], hubs[i], starts[i] + f, l - f + WIDTH, s) for f, l, s in alike_runs(a, b)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
            names=["id", "source_id", "first_word", "n_words", "overlap"],
        )


def _long_runs(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the places ``at`` of several owners the last place up to which the share holds, and whether that
    makes a run that is long enough."""
    rank = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
    own = np.searchsorted(rank, rank)
    # Owners are kept apart by more than any height; see _farthest.
    height = np.arange(len(at)) - own - OVERLAP * (at - at[own])
    apart = rank * (height.max() - height.min() + 1.0)
    highest_behind = np.maximum.accumulate((height - apart)[::-1])[::-1]
    # Heights are multiples of 0.2, so that much rounding is harmless.
    last = np.searchsorted(-highest_behind, -(height - apart - (1 - OVERLAP) - 1e-3), side="right") - 1
    last = np.minimum(last, np.searchsorted(rank, rank, side="right") - 1)
    end = at[last]
    return end, end - at + 1 >= MIN_WORDS - WIDTH + 1


def _in_runs(at: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any run of the places ``at`` of one owner that is long enough and holds the share."""
    if not len(at):
        return np.zeros(n, bool)
    end, long = _long_runs(at, owner)
    inside = np.bincount(at[long], minlength=n + 1) - np.bincount(end[long] + 1, minlength=n + 1)
    return np.cumsum(inside[:-1]) > 0


class _Lists:
    """The windows of several keys with their shingles, and for each shingle of a key the windows that have it."""

    def __init__(self, table: pa.Table):
        self.keys, self.ids, self.left, self.right = (table.column(c).to_numpy() for c in ("key", "id", "left", "right"))
        self.seeks = table.column("seeks").to_numpy(zero_copy_only=False)
        runs = table.column("shingles").combine_chunks()
        sizes = np.diff(runs.offsets.to_numpy())
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), sizes)
        group = np.cumsum(np.concatenate([[0], self.keys[1:] != self.keys[:-1]]))
        self.group = np.searchsorted(group, group)
        marks = (group[self.owner] << 32) | runs.flatten().to_numpy().view(np.uint32).astype(np.int64)
        # Shingles are numbered in the order of a stable sort, which also tells who has each.
        order = np.argsort(marks, kind="stable")
        marks = marks[order]
        new = np.concatenate([[True], marks[1:] != marks[:-1]])[: len(marks)]
        self.shingle = np.empty(len(marks), np.int32)
        self.shingle[order] = np.cumsum(new) - 1
        self.holders = self.owner[order]
        self.first = np.append(np.flatnonzero(new), len(marks))
        # Sorted, so that the holders of a shingle in a range of windows are found by two searches.
        self.held = self.shingle[order] * np.int64(len(self.ids)) + self.holders
        self.unknown = np.ones(len(self.owner), bool)
        seekers = np.flatnonzero(self.seeks)
        for row, spans in zip(seekers.tolist(), table.column("spans").take(pa.array(seekers)).to_pylist()):
            if not spans:
                continue
            place = np.arange(self.left[row], self.left[row] + sizes[row])
            for span in spans:
                self.unknown[self.ends[row] : self.ends[row + 1]] &= (place < span["first"]) | (place > span["last"])

    def seeking(self) -> np.ndarray:
        """Windows that share enough with smaller ids, something new among it, and seek at all."""
        earliest = np.full(self.shingle.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, self.shingle, self.ids[self.owner])
        shared = earliest[self.shingle] < self.ids[self.owner]
        count = lambda mask: np.bincount(self.owner[mask], minlength=len(self.ids))
        seeks = self.seeks & (count(shared) >= _SHARED) & (count(shared & self.unknown) > 0)
        # With one partner no more can be in a run than with all together.
        at = np.flatnonzero(shared & seeks[self.owner])
        self.unknown &= _in_runs(at, self.owner[at], len(shared))
        return np.flatnonzero(seeks & (count(self.unknown) > 0))

    def partners(self, w: int) -> Iterator[int]:
        """The windows of smaller ids with a passage that tells of something new in window w, by id.

        Those of a crowded key are looked at by ids, a few first, so that where these tell of everything the others
        are never looked at; each only counts where it tells of more than those before it, so ranges change nothing.
        """
        mine = slice(self.ends[w], self.ends[w + 1])
        shingle, unknown = self.shingle[mine], self.unknown[mine].copy()
        begin, n, low = int(self.group[w]), _FIRST_LOOK, self.first[shingle]
        before = int(np.searchsorted(self.ids[begin:w], self.ids[w])) + begin
        while begin < before and unknown.any():
            end = min(before, begin + n)
            # The holders of a shingle stand by their numbers, so those of the next range follow.
            high = np.searchsorted(self.held, shingle * np.int64(len(self.ids)) + end)
            yield from self._partners_among(begin, end, low, high, unknown)
            begin, n, low = end, 4 * n, high

    def _holders(self, places: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of the ``sizes`` holders from ``low`` on of the shingles at these places."""
        upto = np.cumsum(sizes)
        return self.holders[np.arange(upto[-1]) + np.repeat(low - upto + sizes, sizes)], np.repeat(places, sizes)

    def _partners_among(self, begin: int, end: int, low: np.ndarray, high: np.ndarray, unknown: np.ndarray) -> Iterator[int]:
        """The partners among the windows from ``begin`` to ``end``, those from ``low`` to ``high`` of the holders of
        each shingle; what they tell of is no longer ``unknown``."""
        sizes, places = high - low, np.arange(len(low), dtype=np.int32)
        # Only windows with something new count, so that the others of a crowded key are not looked at.
        telling = np.zeros(end - begin, bool)
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        # A very wide window of a crowded key is looked up a part at a time.
        upto = np.cumsum(sizes)
        parts = [slice(0, len(low))]
        if upto[-1] > _GATHERED:
            cuts = np.searchsorted(upto, np.arange(_GATHERED, int(upto[-1]) + _GATHERED, _GATHERED)) + 1
            parts = [slice(x, y) for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(low)]) if x < min(y, len(low))]
        for part in parts:
            new = places[part][unknown[part]]
            if len(new):
                telling[self._holders(new, low[new], sizes[new])[0] - begin] = True
        if not telling.any():
            return
        for part in parts:
            holder, where = self._holders(places[part], low[part], sizes[part])
            keep = telling[holder - begin]
            found.append((holder[keep], where[keep]))
        holder, where = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(holder, kind="stable")
        holder, where = holder[order], where[order].astype(np.int64)
        # A shingle that the window has several times stands at each of its places once for a holder.
        once = np.concatenate([[True], (holder[1:] != holder[:-1]) | (where[1:] != where[:-1])])
        holder, where = holder[once], where[once]
        cuts = np.flatnonzero(np.concatenate([[True], holder[1:] != holder[:-1]]))
        ends = np.concatenate([cuts[1:], [len(holder)]])
        far, long = _long_runs(where, holder)
        news = np.concatenate([[0], np.cumsum(unknown)])
        tells = np.logical_or.reduceat(long & (news[far + 1] > news[where]), cuts) & (ends - cuts >= _SHARED)
        for a, b in zip(cuts[tells].tolist(), ends[tells].tolist()):
            at = where[a:b]
            if not unknown[at].any():
                continue
            new = [(f, l) for f, l, _ in _runs_at(at) if unknown[f : l + 1].any()]
            if new:
                yield int(holder[a])
                for f, l in new:
                    unknown[f : l + 1] = False
                if not unknown.any():
                    return


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of windows of one key that tell of passages beyond those known (``spans``); rows come sorted by key.

    A window takes its partners by their ids, each only where it tells of something that no passage before it does, so
    there are no more pairs than there are words to tell of, and nothing is left for another round.
    """

    def settle(table: pa.Table) -> pa.RecordBatch:
        lists, rows = _Lists(table.combine_chunks()), []
        for w in lists.seeking().tolist():
            rows += [(w, e) for e in lists.partners(w)]
        w, e = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        columns = [lists.keys[w], lists.ids[w], lists.ids[e], lists.left[w], lists.right[w], lists.left[e], lists.right[e]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "hub", "left", "right", "hub_left", "hub_right"])

    def parts(table: pa.Table) -> Iterator[pa.Table]:
        """Whole keys, as many as have about ``_PART_SHINGLES`` shingles."""
        keys = table.column("key").to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        upto = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(table.column("shingles")).to_numpy())])[begins]
        at = 0
        while at < len(begins) - 1:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + _PART_SHINGLES, side="right")) - 1)
            yield table.slice(begins[at], begins[end] - begins[at])
            at = end

    held, n, limit = [], 0, 1
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield from map(settle, parts(table.slice(0, cut)))
            held, n, limit = table.slice(cut).to_batches(), n - cut, 1
        else:
            limit = 2 * n
    if n:
        yield from map(settle, parts(pa.Table.from_batches(held)))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of keys that several documents have, with the smallest id of each key and how far its windows
    reach; all rows of a key come to one task."""
    names = ("key", "id", "left", "right")
    held: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        for mine, c in zip(held, names):
            mine.append(batch.column(c).to_numpy())
    if not held[0]:
        return
    key, ids, left, right = (np.concatenate(h) for h in held)
    order = np.lexsort((left, ids, key))
    key, ids, left, right = (x[order] for x in (key, ids, left, right))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    hub = np.repeat(ids[starts], sizes)
    hubs_own = ids == hub
    # A hub that has the key several times is asked with all of its windows.
    low = np.minimum.reduceat(np.where(hubs_own, left, np.iinfo(np.int32).max), starts)
    high = np.maximum.reduceat(np.where(hubs_own, right, -1), starts)
    several = np.repeat(np.logical_or.reduceat(~hubs_own, starts), sizes)
    columns = (key, ids, left, right, hub, np.repeat(low, sizes), np.repeat(high, sizes))
    for at in range(0, len(key), 1 << 16):
        part = np.flatnonzero(several[at : at + (1 << 16)]) + at
        yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in columns], names=[*names, "hub", "hub_left", "hub_right"])


_WINDOW = "key bigint, id bigint, left int, right int"
_PAIR = "key bigint, id bigint, hub bigint, left int, right int, hub_left int, hub_right int"
_STRETCH = "id bigint, hub bigint, left int, right int, hub_left int, hub_right int"
_PASSAGE = "id bigint, source_id bigint, first_word int, n_words int, overlap double"


def _own_keys(lean: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows with a key of their own as id; where ids repeat also (key, id, text_hash) of all."""
    if lean.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return lean, None
    hashed = lean.withColumn("text_hash", F.xxhash64("text"))
    rows = written(hashed.select("id", "text_hash").distinct().withColumn("row", F.struct("id", "text_hash")), "rows")
    names = written(ranked(rows, "row").select(F.col("code").alias("key"), "id", "text_hash"), "names")
    return hashed.join(names, ["id", "text_hash"]).select(F.col("key").alias("id"), "text"), names


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, source_id, first_word, n_words, overlap, text_hash): passages that a document with a smaller id has too.

    Each passage has at least 50 words, begins and ends with a shingle of the other document, and at least 0.8 of its
    five-word shingles occur in the other's stretch. The documents of a window are first paired with the one that has
    the smallest id. What that leaves uncovered is settled window key by window key: partners are taken by their ids,
    each only where it tells of more, so pairs grow with the words and two rounds do. Words are white-space separated,
    A-Z lower-cased. Null and short texts and rows with a null id have no passages. Rows with equal ids and different
    texts count as documents of their own, by the hash of their text, which ``text_hash`` then tells; it is null
    where the id has one row. Passages that repeat inside one document only are not reported; other columns are not
    read; an empty table gives an empty result.
    """
    lean, names = _own_keys(
        docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).filter("id is not null and text is not null")
    )
    n_bytes = lean.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(partitions(docs), -(-n_bytes // _PART_BYTES))
    windows = lean.mapInArrow(_windows, _WINDOW).repartition(parts, "key")
    met = written(windows.mapInArrow(_met, f"{_WINDOW}, hub bigint, hub_left int, hub_right int"), "met")
    part_of = lambda c, left, right: F.slice(c, F.col(left) + 1, F.col(right) - F.col(left) + 1)

    def arrays_of(ids: DataFrame) -> DataFrame:
        read = with_ids(lean, written(ids.distinct(), "ids"), "id").mapInArrow(_arrays, "id bigint, shingles array<int>")
        # Only equal rows can have one key.
        return read if names is None else read.dropDuplicates(["id"])

    def verified(pairs: DataFrame, least: int) -> DataFrame:
        sorted_pairs = pairs.repartition("id", "hub").sortWithinPartitions("id", "hub", "left")
        stretches = written(
            sorted_pairs.select("key", "id", "hub", "left", "right", "hub_left", "hub_right").mapInArrow(lambda b: _stretches(b, least), _STRETCH), "stretches"
        )
        arrays = written(arrays_of(stretches.select(F.explode(F.array("id", "hub")).alias("id"))), "shingles")
        own = stretches.join(arrays, "id").select("id", "hub", "left", "hub_left", "hub_right", part_of("shingles", "left", "right").alias("own"))
        both = own.join(arrays.select(F.col("id").alias("hub"), "shingles"), "hub").select(
            "id", "hub", "left", "own", part_of("shingles", "hub_left", "hub_right").alias("other")
        )
        told = written(both.mapInArrow(_verify, _PASSAGE), "passages")
        discard(arrays)
        return told

    found = verified(met.filter("id > hub"), ENOUGH)
    last_shingle = F.col("first_word") + F.col("n_words") - WIDTH
    spans = written(found.select("id", F.col("first_word").alias("first"), last_shingle.alias("last")).distinct(), "spans")
    # Windows inside a passage seek no longer, but others may still find them.
    rest = met.filter("id <> hub").select("key", "id", "left", "right")
    covered = rest.join(spans, "id").filter("first <= left and right <= last").select("key", "id", "left").distinct()
    rest = rest.join(covered.withColumn("covered", F.lit(True)), ["key", "id", "left"], "left").withColumn("seeks", F.col("covered").isNull())
    rest = written(rest.drop("covered"), "rest")
    discard(met)
    alive = rest.groupBy("key").agg(F.min("id").alias("low"), F.max(F.when(F.col("seeks"), F.col("id"))).alias("high")).filter("low < high")
    rest = written(rest.join(alive.select("key", "high"), "key").filter("id <= high").drop("high"), "rest")
    held = spans.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    full = rest.join(arrays_of(rest.select("id")), "id").select(
        "key", "id", "left", "right", "seeks", part_of("shingles", "left", "right").alias("shingles")
    )
    full = full.join(held, "id", "left").repartition(parts, "key").sortWithinPartitions("key", "id", "left")
    columns = ("key", "id", "left", "right", "seeks", "shingles", "spans")
    settled = written(full.select(*columns).mapInArrow(_settled, _PAIR), "pairs")
    inside = (F.col("first") <= F.col("first_word")) & (F.col("last") >= last_shingle)
    more = verified(settled, 1).join(spans.withColumnRenamed("id", "span_id"), (F.col("id") == F.col("span_id")) & inside, "left_anti")
    told = found.unionByName(written(more, "more"))
    if names is None:
        return told.withColumn("text_hash", F.lit(None).cast("bigint")).withColumnRenamed("id", id_column)
    whose = names.select(F.col("key").alias("id"), F.col("id").alias(id_column), "text_hash")
    source = names.select(F.col("key").alias("source_id"), F.col("id").alias("source"))
    repeats = told.join(whose, "id").join(source, "source_id").drop("id", "source_id").withColumnRenamed("source", "source_id")
    return repeats.select(id_column, "source_id", "first_word", "n_words", "overlap", "text_hash")


def _cut(text_column: str, spans_column: str):
    """Take the passages out of the texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            for part in slices(batch, text_column, _LEAN_BYTES):
                data, offsets = buffers(part.column(at))
                _, starts, ends, bounds = word_hashes(data, offsets)
                spans = part.column(spans_column).to_pylist()
                texts = []
                for i, mine in enumerate(spans):
                    done, left = int(offsets[i]), []
                    for first, n in sorted((s["first_word"], s["n_words"]) for s in mine or ()):
                        begin, stop = int(starts[bounds[i] + first]), int(ends[bounds[i] + first + n - 1])
                        left.append(bytes(data[done : max(begin, done)]))
                        done = max(done, stop)
                    left.append(bytes(data[done : offsets[i + 1]]))
                    texts.append(b"".join(left).decode())
                out = part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                yield out.drop_columns([spans_column])

    return cut


def without_passages(docs: DataFrame, passages: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without the ``passages`` found in them; other rows and columns stay as they are.

    Of several rows with one id each loses its own passages, told apart by the hash of the text. Documents without
    passages are not moved. The passages of a document are bounded by its length.
    """
    grouped = written(
        passages.groupBy(F.col(id_column).alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.collect_list(F.struct("first_word", "n_words")).alias("__spans")), "spans"
    )
    ids = written(grouped.select(F.col("__id").alias(id_column)).distinct(), "ids")
    mine = (F.col(id_column) == F.col("__id")) & (F.col("__hash").isNull() | (F.col("__hash") == F.xxhash64(text_column)))
    near = with_ids(docs, ids, id_column)
    touched = near.join(F.broadcast(grouped) if ids.count() <= BROADCAST_IDS else grouped, mine, "left").drop("__id", "__hash")
    return with_ids(docs, ids, id_column, "left_anti").unionByName(
        touched.select(*docs.columns, "__spans").mapInArrow(_cut(text_column, "__spans"), docs.schema)
    )
