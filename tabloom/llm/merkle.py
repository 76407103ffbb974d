"""Merkle manifest of a dataset: one tree for each source, a tree over the sources, and a proof for every row.

Each level turns runs of 16 nodes into their hash until one is left. Leaves are dealt to ranges of (source, id), so a
partition holds a stretch of one tree, or several whole trees. Whatever a partition can hash alone stays there; of the
rest it publishes the topmost nodes, from which the few nodes above are derived level by level. For its proofs it asks
for the union of the nodes that it misses (at most 15 on either side and level, the octopus), gets them once, derives
the nodes inside, and expands a proof for each of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import partitions

ARITY = 16
_HEX = 64
# Leaves of a range, which one task holds (some 100 bytes each).
_RANGE_ROWS = 250_000
# The tree over the sources; those of sources are numbered from 0.
_TOP = -1

# Rows of a batch of proofs.
_BATCH = 10_000

_PLACED = "pid int, seg int, at bigint, source string, id {kind}, leaf binary, claimed binary"
_NODES = "pid int, tree bigint, level int, at bigint, size bigint, digest binary"
_PROOFS = "id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex sha256 of the fields: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value as text."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def _hash(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def _parents(nodes: bytes) -> bytes:
    """The hashes of all runs of 16 nodes, one after the other as hex text."""
    step = ARITY * _HEX
    return b"".join(_hash(nodes[i : i + step]) for i in range(0, len(nodes), step))


def _root_of(nodes: bytes) -> bytes:
    while len(nodes) > _HEX:
        nodes = _parents(nodes)
    return nodes


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition: ``seg`` counts its sources, ``at`` the rows of each."""
    pid, seg, at, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        segs, ats = [], []
        for source in batch.column("source").to_pylist():
            if seg < 0 or source != last:
                seg, at, last = seg + 1, 0, source
            segs.append(seg)
            ats.append(at)
            at += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([pid] * len(segs), pa.int32()), pa.array(segs, pa.int32()), pa.array(ats, pa.int64()),
                *(batch.column(c) for c in ("source", "id", "leaf", "claimed")),
            ],
            names=["pid", "seg", "at", "source", "id", "leaf", "claimed"],
        )


class _Part:
    """What the driver knows of a range: its sources and how its first and last one lie in their trees."""

    def __init__(self, rank: int, segs: int, before: int, first_size: int, last_size: int):
        self.rank, self.segs, self.before, self.first_size, self.last_size = rank, segs, before, first_size, last_size

    def span(self, seg: int, rows: int) -> tuple[int, int, int]:
        """(first leaf, end, leaves of the tree) of one of its sources."""
        low = self.before if seg == 0 else 0
        size = self.first_size if seg == 0 else self.last_size if seg == self.segs - 1 else rows
        return low, low + rows, size


def _parts(placed: DataFrame) -> tuple[dict[int, _Part], int]:
    """The ranges by number, and the number of sources: a few numbers for each range, whatever the rows."""
    each = placed.groupBy("pid", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source"))
    one = F.struct("seg", "n", "source")
    rows = each.groupBy("pid").agg(F.min(one).alias("low"), F.max(one).alias("high")).orderBy("pid").collect()
    # Sizes of the trees that ranges begin or end in; a tree that goes on in the next range keeps its number.
    rank, starts, sizes = -1, {}, {}
    for i, r in enumerate(rows):
        goes_on = i > 0 and rows[i - 1].high.source == r.low.source
        rank += 0 if goes_on else 1
        starts[r.pid] = (rank, sizes.get(rank, 0))
        sizes[rank] = sizes.get(rank, 0) + r.low.n
        if r.high.seg > 0:
            rank += r.high.seg
            sizes[rank] = r.high.n
    parts = {
        r.pid: _Part(starts[r.pid][0], r.high.seg + 1, starts[r.pid][1], sizes[starts[r.pid][0]], sizes[starts[r.pid][0] + r.high.seg])
        for r in rows
    }
    return parts, rank + 1


def _publish(nodes: bytes, low: int, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(level, place, nodes of the level, digest) of the topmost nodes that a stretch of a level yields alone."""
    level = 0
    while nodes:
        high = low + len(nodes) // _HEX
        if size == 1:
            yield level, 0, 1, nodes
            return
        inner = -(-low // ARITY) * ARITY
        outer = high if high == size else high // ARITY * ARITY
        inner, outer = (inner, outer) if inner < outer else (high, high)
        for i in (*range(low, inner), *range(outer, high)):
            yield level, i, size, nodes[(i - low) * _HEX : (i - low + 1) * _HEX]
        nodes = _parents(nodes[(inner - low) * _HEX : (outer - low) * _HEX])
        low, size, level = inner // ARITY, -(-size // ARITY), level + 1


def _missing(low: int, high: int, size: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes beside a stretch of leaves that all its proofs need, and no others."""
    level = 0
    while size > 1:
        left, right = low // ARITY * ARITY, min(-(-high // ARITY) * ARITY, size)
        yield from ((level, i) for i in (*range(left, low), *range(high, right)))
        low, high, size, level = left // ARITY, -(-right // ARITY), -(-size // ARITY), level + 1


def _by_part(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[int, list[list[Any]]]]:
    """The columns of each range; rows come sorted by range."""
    held: list[list[Any]] = [[] for _ in columns]
    pid = None
    for batch in batches:
        pids = batch.column("pid").to_pylist()
        values = [batch.column(c).to_pylist() for c in columns]
        at = 0
        while at < len(pids):
            if pids[at] != pid:
                if pid is not None:
                    yield pid, held
                pid, held = pids[at], [[] for _ in columns]
            end = at
            while end < len(pids) and pids[end] == pid:
                end += 1
            for mine, value in zip(held, values):
                mine += value[at:end]
            at = end
    if pid is not None:
        yield pid, held


def _segments(segs: list[int]) -> Iterator[tuple[int, int, int]]:
    """(number, first row, end) of each source of a range."""
    at = 0
    while at < len(segs):
        end = at
        while end < len(segs) and segs[end] == segs[at]:
            end += 1
        yield segs[at], at, end
        at = end


def _offered(parts: dict[int, _Part], n_sources: int) -> Callable:
    """What each range publishes (with a digest) and asks for (without)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, (segs, leaves) in _by_part(batches, ("seg", "leaf")):
            part = parts[pid]
            out: list[tuple] = []
            whole: list[bytes] = []
            whole_low = None
            for seg, a, b in _segments(segs):
                tree = part.rank + seg
                low, high, size = part.span(seg, b - a)
                nodes = b"".join(leaves[a:b]).hex().encode()
                if high - low == size:
                    whole_low = tree if whole_low is None else whole_low
                    whole.append(_root_of(nodes))
                else:
                    out += [(None, tree, *node) for node in _publish(nodes, low, size)]
                    out += [(pid, tree, level, i, None, None) for level, i in _missing(low, high, size)]
            if whole:
                out += [(None, _TOP, *node) for node in _publish(b"".join(whole), whole_low, n_sources)]
            out += [(pid, _TOP, level, i, None, None) for level, i in _missing(part.rank, part.rank + part.segs, n_sources)]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            digests = pa.array([r[5] and bytes.fromhex(r[5].decode()) for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, digests], names=["pid", "tree", "level", "at", "size", "digest"])

    return run


def _derived(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """All nodes above the published ones, a level at a time, and the roots of their trees."""
    known, this = nodes, nodes.filter("level = 0")
    for level in range(levels):
        hexes = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: F.lower(F.hex(x["digest"])))
        up = (
            this.filter("size > 1").groupBy("tree", F.floor(F.col("at") / ARITY).alias("place"))
            .agg(F.unhex(F.sha2(F.array_join(hexes, ""), 256)).alias("digest"), F.ceil(F.max("size") / ARITY).alias("size"))
            .select(F.lit(None).cast("int").alias("pid"), "tree", F.lit(level + 1).alias("level"), F.col("place").alias("at"), "size", "digest")
        )
        up = written(up, "nodes")
        known = known.unionByName(up)
        this = nodes.filter(F.col("level") == level + 1).unionByName(up)
    return known, known.filter("size = 1")


def _levels(size: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


class _Stretch:
    """A stretch of leaves with the nodes around it: every level as far as its proofs need it."""

    def __init__(self, nodes: bytes, low: int, size: int, fetched: dict[tuple[int, int], bytes]):
        self.levels: list[tuple[int, bytes]] = []
        high, level = low + len(nodes) // _HEX, 0
        while size > 1:
            left, right = low // ARITY * ARITY, min(-(-high // ARITY) * ARITY, size)
            nodes = b"".join([*(fetched[level, i] for i in range(left, low)), nodes, *(fetched[level, i] for i in range(high, right))])
            self.levels.append((left, nodes))
            nodes = _parents(nodes)
            low, high, size, level = left // ARITY, -(-right // ARITY), -(-size // ARITY), level + 1
        self.root = nodes

    def path(self, at: int, first: int = 0, end: int | None = None) -> list[tuple[bytes, bytes]]:
        """What stands in front of the leaf's ancestor and behind it in its run, on the levels from ``first`` to ``end``."""
        found = []
        for level, (left, nodes) in list(enumerate(self.levels))[first:end]:
            own = at // ARITY**level
            begin, mine = (own // ARITY * ARITY - left) * _HEX, (own - left) * _HEX
            found.append((nodes[begin:mine], nodes[mine + _HEX : begin + ARITY * _HEX]))
        return found


def _expanded(parts: dict[int, _Part], n_sources: int, kind: pa.DataType) -> Callable:
    """The proof of every row of a range, folded with what the row claims to be."""

    def proofs(own: _Stretch, above: list[tuple[bytes, bytes]], root: bytes, low: int, leaves: list, claims: list) -> Iterator[tuple]:
        group, upper = None, above
        for at, (leaf, claimed) in enumerate(zip(leaves, claims), low):
            if at // ARITY != group:
                group = at // ARITY
                upper = own.path(at, 1) + above
            path = own.path(at, 0, 1) + upper
            leaf = leaf.hex().encode()
            folded = leaf if claimed is None else claimed.hex().encode()
            for front, behind in path:
                folded = _hash(front + folded + behind)
            yield leaf.decode(), _hash(b"".join(x for pair in path for x in pair)).decode(), folded.decode(), folded == root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("tree", "level", "at", "digest", "seg", "id", "claimed")
        for pid, (trees, levels, ats, digests, segs, ids, claims) in _by_part(batches, columns):
            part, n_got = parts[pid], sum(t is not None for t in trees)
            got: dict[int, dict[tuple[int, int], bytes]] = {}
            for i in range(n_got):
                got.setdefault(trees[i], {})[levels[i], ats[i]] = digests[i].hex().encode()
            stretches = []
            for seg, a, b in _segments(segs[n_got:]):
                low, _, size = part.span(seg, b - a)
                nodes = b"".join(digests[n_got + a : n_got + b]).hex().encode()
                stretches.append((n_got + a, n_got + b, low, _Stretch(nodes, low, size, got.get(part.rank + seg, {}))))
            top = _Stretch(b"".join(own.root for *_, own in stretches), part.rank, n_sources, got.get(_TOP, {}))
            for seg, (a, b, low, own) in enumerate(stretches):
                above = top.path(part.rank + seg)
                for i in range(a, b, _BATCH):
                    end = min(i + _BATCH, b)
                    told = list(zip(*proofs(own, above, top.root, low + i - a, digests[i:end], claims[i:end])))
                    same = lambda text: pa.array([text.decode()] * (end - i), pa.string())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i:end], kind), pa.array(told[0]), same(own.root), same(top.root), *map(pa.array, told[1:])],
                        names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                    )

    return run


def merkle_proofs(leaves: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of (id, source, leaf, claimed).

    ``leaf`` is a hex sha256. Per source, leaves ascend by id (null first; equal ids by leaf); every run of 16 becomes
    its hash until one node is left, the subroot, a lone leaf itself. The subroots, by source (null first, UTF-8
    bytewise), become the root likewise. ``proof_sha256`` is the hash of all siblings on the way from the leaf to the
    root, level by level, left to right; without any, that of nothing. ``folded_root`` is the root recomputed from
    ``claimed``, or from the leaf where that is null, with the same siblings, and ``verified`` whether it is the root.
    Rows that are equal in all columns each have a place; an empty table gives an empty result.
    """
    spark = leaves.sparkSession
    kind = leaves.schema["id"].dataType
    name, arrow = kind.simpleString(), pa.string() if isinstance(kind, T.StringType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()
    if not isinstance(kind, (T.StringType, T.LongType, T.IntegerType)):
        raise ValueError("ids are strings, bigints or ints")
    lean = leaves.select("source", "id", F.unhex("leaf").alias("leaf"), F.unhex("claimed").alias("claimed"))
    # Equal rows have equal leaves, so their order is free; the last column lets a range end between them.
    order = ["source", "id", "leaf", "tie"]
    n_ranges = max(partitions(leaves), -(-leaves.count() // _RANGE_ROWS))
    dealt = lean.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    placed = written(dealt.select("source", "id", "leaf", "claimed").mapInArrow(_placed, _PLACED.format(kind=name)), "leaves")
    parts, n_sources = _parts(placed)
    if not parts:
        return spark.createDataFrame([], _PROOFS.format(kind=name))
    by_part = placed.repartition(n_ranges, "pid").sortWithinPartitions("pid", "seg", "at").select("pid", "seg", "leaf")
    offered = written(by_part.mapInArrow(_offered(parts, n_sources), _NODES), "offered")
    nodes = offered.filter("digest is not null")
    deepest = max(max(p.first_size, p.last_size) for p in parts.values())
    known, roots = _derived(nodes.filter(F.col("tree") != _TOP), _levels(deepest))
    subroots = roots.select("pid", F.lit(_TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("at"), F.lit(n_sources).cast("bigint").alias("size"), "digest")
    above, _ = _derived(nodes.filter(F.col("tree") == _TOP).unionByName(subroots), _levels(n_sources))
    all_nodes = known.unionByName(above).select("tree", "level", "at", "digest")
    fetched = offered.filter("digest is null").select("pid", "tree", "level", "at").join(all_nodes, ["tree", "level", "at"])
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = fetched.select("pid", "tree", "level", "at", "digest", blank("int", "seg"), blank(name, "id"), blank("binary", "claimed"))
    rows = placed.select("pid", blank("bigint", "tree"), blank("int", "level"), "at", F.col("leaf").alias("digest"), "seg", "id", "claimed")
    both = asked.unionByName(rows).repartition(n_ranges, "pid").sortWithinPartitions("pid", F.col("tree").asc_nulls_last(), "seg", "at")
    return both.mapInArrow(_expanded(parts, n_sources, arrow), _PROOFS.format(kind=name))
