"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped
candidate edges, and links confirmed on full shingle sets.

Documents with equal sets collapse into one representative first. In a bucket every member is compared with one hub
first; only members that this leaves undecided are compared with others, so that pairs stay near the rows of the
buckets and no link between two members of a bucket that would join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.lookup import lookup_join
from ..session import written
from .common import partitions, with_ids
from .words import buffers, mix, shingles, slices, word_hashes

WIDTH = 3
PERCENT = 85
# 48 bands of 8 bins: two sets at a likeness of 0.85 miss each other in all bands with a chance of 2.4e-7. Lower
# likenesses take narrower bands, until that chance is below MISS.
BANDS = 48
ROWS = 8
BINS = BANDS * ROWS
MISS = 1e-6
_BYTES = 1 << 20
# Rows of a bucket, and pairs of sets, that a task of the later rounds takes.
_TASK_ROWS = 200_000
_TASK_PAIRS = 20_000
# Sets of a block, and shingles that two blocks are compared on at a time.
_BLOCK = 64
_COLUMNS = 1 << 14


def _probe_orders() -> np.ndarray:
    """For each bin the order in which it asks the others for a value when it is empty; the same for all sets."""
    bins = np.arange(BINS, dtype=np.uint64)
    return np.argsort(mix(bins[:, None] * np.uint64(BINS) + bins[None, :] + np.uint64(1)), axis=1)


_PROBES = _probe_orders()


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text and their bounds; a shorter text is one shingle, no words none."""
    words, _, _, bounds = word_hashes(*buffers(texts))
    found, found_bounds = shingles(words, bounds, width)
    counts = np.diff(found_bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    n_words = np.diff(bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        whole = np.array([_whole(words[bounds[i] : bounds[i + 1]]) for i in short], np.uint64)
        found, row = np.concatenate([found, whole]), np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(counts) + 1))


def _whole(words: np.ndarray) -> np.uint64:
    total = np.array([len(words)], np.uint64)
    for w in words:
        total = mix(total * np.uint64(0x100000001B3) + w)
    return mix(total + np.uint64(1))[0]


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``BINS`` minima for each non-empty set: hashes are dealt to bins by their upper bits."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = (sets >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)
    cell = row * BINS + place.astype(np.int64)
    # Sets are sorted, so the first hash in a bin is its smallest.
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    values = np.zeros(len(sizes) * BINS, np.uint64)
    filled = np.zeros(len(sizes) * BINS, bool)
    values[cell[first]], filled[cell[first]] = sets[first], True
    full = filled.copy()
    open_cells = np.flatnonzero(~filled & np.repeat(sizes > 0, BINS))
    base, bins = open_cells - open_cells % BINS, open_cells % BINS
    for step in range(BINS):
        if not len(open_cells):
            break
        donor = base + _PROBES[bins, step]
        hit = full[donor]
        values[open_cells[hit]] = values[donor[hit]]
        open_cells, base, bins = open_cells[~hit], base[~hit], bins[~hit]
    return values.reshape(-1, BINS)


def band_rows(percent: int) -> int:
    """Bins of a band, for sets with a likeness of ``percent`` %."""
    fits = (r for r in range(ROWS, 1, -1) if BINS % r == 0 and (1 - (percent / 100) ** r) ** (BINS // r) <= MISS)
    return next(fits, 1)


def band_keys(signature: np.ndarray, width: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``width`` bins; different bands never share keys by construction of the hash."""
    rows = signature.reshape(len(signature), BINS // width, width)
    total = np.broadcast_to(np.arange(1, BINS // width + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(width):
        total = mix(total * np.uint64(0x100000001B3) + rows[:, :, i])
    return total


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _sign(width: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                sets, bounds = shingle_sets(part.column("text"), width)
                keys = band_keys(signatures(sets, bounds), rows).astype(np.int64)
                n = np.diff(bounds)
                one, two = (_sums(mix(sets ^ np.uint64(salt)), bounds).astype(np.int64) for salt in (0x5BD1, 0xC2B2))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BINS // rows, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(n.astype(np.int64)), pa.array(one), pa.array(two),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel())),
                    ],
                    names=["id", "n_shingles", "one", "two", "bands"],
                )

    return sign


def _sets(width: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                sets, bounds = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.astype(np.int64)))],
                    names=["id", "shingles"],
                )

    return collect


def _first_hubs(rows: DataFrame) -> DataFrame:
    """(key, hub) of the buckets with two members or more. Which member is the hub varies with the bucket."""
    order = F.col("id").bitwiseXOR(F.col("key"))
    ends = rows.groupBy("key").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    return ends.filter("low <> high").select("key", F.col("low").bitwiseXOR(F.col("key")).alias("hub"))


def _compared(pairs: DataFrame, n: int, sets: DataFrame, percent: int) -> DataFrame:
    """Add to ``n`` pairs (a, b) whether they are linked, and their distance."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    near = with_ids(sets, ids, "id")
    left = near.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = near.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    sized = pairs.join(left, "a").join(right, "b").select(
        "a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either")
    )
    linked = F.col("both") * 100 >= F.col("either") * percent
    told = sized.select("a", "b", linked.alias("linked"), (1 - F.col("both") / F.col("either")).alias("d"))
    return written(told.coalesce(-(-n // _TASK_PAIRS) or 1), "pairs")


def _links(reps: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b) that connect all representatives with a likeness of at least ``percent`` % in a common bucket.

    Members of a bucket are first compared with one hub. What that leaves undecided is narrowed by three exact rules:
    distances to the hub, a metric; components of the links found so far; and shingles that no other undecided
    document has, which bound a document's likeness to all others. The rest is compared block by block.
    """
    apart = 1 - percent / 100
    rows = reps.select("id", F.explode("bands").alias("key"))
    met = written(rows.join(_first_hubs(rows), "key").filter("id <> hub"), "buckets")
    pairs = written(met.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "asked")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = written(with_ids(docs, ids, "id").mapInArrow(_sets(width), "id bigint, shingles array<bigint>").dropDuplicates(["id"]), "sets")
    known = _compared(pairs, pairs.count(), sets, percent)
    links = known.filter("linked").select("a", "b")
    # A member that the hub links can only be linked to one that it rejects if their distances to the hub differ by
    # no more than a link allows.
    far = met.join(known.withColumnsRenamed({"a": "hub", "b": "id"}), ["hub", "id"])
    nearest = far.filter("not linked").groupBy("key").agg(F.min("d").alias("nearest"))
    rows = far.join(nearest, "key").filter(~F.col("linked") | (F.col("d") + apart + 1e-9 >= F.col("nearest"))).select("key", "id")
    rows = written(rows, "rows")
    rows, n = _undecided(rows, rows.count(), links)
    if not n:
        return links
    rows = rows.join(_own_shingles(rows, sets), "id")
    # Of x's shingles the other can have all but its own, and it has at least the bucket's least size.
    least = rows.groupBy("key").agg(F.min("size").alias("least"))
    shared = F.col("size") - F.col("own")
    rows = rows.join(least, "key").filter(shared * 100 >= (F.greatest("least", shared) + F.col("own")) * percent)
    rows, n = _in_several(_sized(rows.select("key", "id", "root"), n), n)
    return links.unionAll(_links_of_rest(rows, n, sets, percent)) if n else links


def _links_of_rest(rows: DataFrame, n: int, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the members of undecided buckets (key, id, root) across components.

    The buckets with one prevailing component form a group. Its members outside that component, the seekers, are
    compared with all members, a block of each in one row, and only links come out.
    """
    tally = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    prevailing = tally.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top")).select("key", F.col("top.root").alias("group"))
    members = _sized(rows.join(prevailing, "key").select("group", "id", "root").distinct(), n)
    seekers = members.filter("root <> group")

    def blocks(side: DataFrame, names: tuple[str, str]) -> DataFrame:
        numbers = side.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
        placed = side.join(numbers, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        one = F.struct("id", "root", "shingles")
        return placed.join(sets, "id").groupBy("group", F.col("block").alias(names[0])).agg(F.collect_list(one).alias(names[1]))

    asking, asked = written(blocks(seekers, ("x", "seekers")), "asking"), written(blocks(members, ("y", "members")), "blocks")
    pairs = asking.join(asked, "group").repartition(partitions(rows), "group", "x", "y").select("seekers", "members")
    return written(pairs.mapInArrow(_linked_in_blocks(percent), "a bigint, b bigint").distinct(), "links")


def _linked_in_blocks(percent: int):
    """For each seeker one link to each component that a member of the other block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values for c in ("seekers", "members"))
                x_ids, y_ids, x_roots, y_roots = (s.field(c).to_numpy() for c in ("id", "root") for s in (x, y))
                both = _common(x.field("shingles"), y.field("shingles"))
                n_x, n_y = (pa.compute.list_value_length(s.field("shingles")).to_numpy().astype(np.int64) for s in (x, y))
                hit = (both * 100 >= (n_x[:, None] + n_y[None, :] - both) * percent) & (x_roots[:, None] != y_roots[None, :])
                a, b = np.nonzero(hit)
                _, first = np.unique(np.stack([a, y_roots[b]]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(x_ids[a[first]]), pa.array(y_ids[b[first]])], names=["a", "b"])

    return run


def _common(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """The number of common values of each pair of lists, a slice of the values at a time."""
    n_x, n_y = len(x), len(y)
    rows = np.repeat(np.arange(n_x + n_y), np.concatenate([pa.compute.list_value_length(s).to_numpy() for s in (x, y)]))
    values, column = np.unique(np.concatenate([s.flatten().to_numpy() for s in (x, y)]), return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((n_x, n_y), np.int64)
    for at in range(0, len(values), _COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + _COLUMNS]))
        table = np.zeros((n_x + n_y, _COLUMNS), np.float32)
        table[rows[part], column[part] - at] = 1
        both += (table[:n_x] @ table[n_x:].T).astype(np.int64)
    return both


def _sized(df: DataFrame, rows: int, label: str = "rows") -> DataFrame:
    """Write a table with as many tasks as that number of rows needs."""
    return written(df.coalesce(-(-rows // _TASK_ROWS) or 1), label)


def _undecided(rows: DataFrame, n: int, links: DataFrame) -> tuple[DataFrame, int]:
    """Add the component by the links as ``root``, and keep the buckets that have members of several; the count."""
    if not n:
        return rows.withColumn("root", F.col("id")), 0
    roots = components(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), links)
    rooted = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return _in_several(_sized(rooted, n), n)


def _in_several(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    ends = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    kept = _sized(rows.join(ends.select("key"), "key"), n)
    return kept, kept.count()


def _own_shingles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, size, own): the shingles of each document in ``rows``, and how many of them no other there has."""
    ids = written(rows.select("id").distinct(), "ids")
    mine = written(with_ids(sets, ids, "id"), "sets")
    single = (
        mine.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    )
    return mine.join(single, "id", "left").select("id", F.size("shingles").alias("size"), F.coalesce("own", F.lit(0)).alias("own"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id, kept): near-duplicate groups by shingles of ``width`` words, one kept of each.

    A shorter text counts as one shingle. Two documents are linked where 100 times the intersection of their sets is
    at least ``percent`` times the union; a component's id is the smallest document id in it and only that document
    is kept. A text that is null, empty or without words is linked with nothing and is its own component. A
    document with a null id has no shared group either: its component is null and it is kept. Rows with equal ids
    count as one document. Other columns are not read; an empty table gives an empty result.
    """
    lean = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    signed = written(
        lean.mapInArrow(_sign(width, band_rows(percent)), "id bigint, n_shingles bigint, one bigint, two bigint, bands array<bigint>")
        .withColumn("set_key", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.concat_ws("/", "n_shingles", "one", "two")))
        .drop("one", "two"), "signed",
    )
    grouped = signed.filter("set_key is not null")
    classes = written(grouped.groupBy("set_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("__n")), "classes")
    reps = written(grouped.join(classes.select("set_key", "id"), ["set_key", "id"]).select("id", "bands"), "reps")
    edges = written(_links(reps, lean, percent, width).distinct(), "links")
    vertices = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = components(vertices, edges)
    table = classes.join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("component_id"), "__n")
    return (
        lookup_join(signed.select("id", "n_shingles", "set_key"), written(table, "classes"), "set_key")
        .withColumn("component_id", F.coalesce("component_id", "id"))
        .select(
            F.col("id").alias(id_column), "n_shingles", "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
