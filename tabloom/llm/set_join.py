"""Jaccard self-join of n-gram sets: prefix index with block skipping, answers derived from those of a similar set.

Two sets with a likeness of at least the threshold share the first of their common shingles, in any order of all
shingles, within a short prefix of each. Two orders are used. By hash, twice the needed prefix tells how many shingles
a set must share with one partner, and drops the many sets that share too few with all others together. Of what is
left whole sets are read, shingles are ordered by how many sets have them, those of a single set dropped, and the rest
of each prefix is indexed.

An index list is kept in blocks of equal set size and position. Each list has one leader, the member with the fewest
shingles of its own; a block is skipped whole where size or position rule a link to the leader out, its other members
are compared with the leader. All that links to the leader is one class, so only members of different classes are left
to compare. Their answers are derived from those of the leader: with what each set lacks of it and has beyond it, the
overlap of two sets is |leader| less both lacks, plus their common lacks, plus their common extras.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.lookup import lookup_join
from ..session import written
from .common import partitions, with_ids
from .words import buffers, mix, shingles, slices, word_hashes

WIDTH = 4
PERCENT = 85
_BYTES = 1 << 20
# Rows of an index part, which one task holds (16 to 40 bytes each).
_PART_ROWS = 2_000_000
# Pairs of sets that a task compares; members that share a copy of their leader; sets of a block of the last step.
_TASK_PAIRS = 20_000
_LEADER_ROWS = 1_000
_BLOCK = 64
# Columns of the matrix that two blocks are compared with at a time.
_COLUMNS = 1 << 14


def _least(n, percent: int):
    """The least overlap of a set of n shingles with any set it is linked to."""
    return -(-n * percent // 100)


def _spare(n, percent: int):
    """Shingles of the hash prefix beyond the first that must be shared; at least 1, growing with n."""
    return np.maximum(n - _least(n, percent), 1)


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text and their bounds; a shorter text is one shingle, no words none."""
    words, _, _, bounds = word_hashes(*buffers(texts))
    found, ends = shingles(words, bounds, width)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    n_words = np.diff(bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        whole = n_words[short].astype(np.uint64)
        for i in range(width - 1):
            has = n_words[short] > i
            word = words[np.minimum(bounds[short] + i, len(words) - 1)]
            whole = np.where(has, mix(whole * np.uint64(0x100000001B3) + word), whole)
        found, row = np.concatenate([found, mix(whole + np.uint64(1))]), np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(ends)))


def _names(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits that equal sets, and only they, have in common."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0x5BD1)), dtype=np.uint64)])
    return mix(upto[bounds[1:]] - upto[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _sized(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                sets, bounds = _sets(part.column("text"), width)
                columns = [part.column("id"), pa.array(_names(sets, bounds)), pa.array(np.diff(bounds).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "set", "n"])

    return run


def _prefixes(width: int, percent: int) -> Callable:
    """(token, set) of the first shingles by hash; a task tells of each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                sets, bounds = _sets(part.column("text"), width)
                names, n = _names(sets, bounds), np.diff(bounds)
                length = np.where(n > 0, n - _least(n, percent) + _spare(n, percent), 0)
                for i, name in enumerate(names.tolist()):
                    if name in told:
                        length[i] = 0
                    told.add(name)
                row = np.repeat(np.arange(len(n)), length)
                place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
                tokens = sets[bounds[row] + place].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(names[row])], names=["token", "set"])

    return run


def _whole(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _BYTES):
                sets, bounds = _sets(part.column("text"), width)
                arrays = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_names(sets, bounds)), arrays], names=["set", "shingles"])

    return run


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray]:
    held: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
    for batch in batches:
        for mine, c in zip(held, names):
            mine.append(batch.column(c).to_numpy(zero_copy_only=False))
    return [np.concatenate(h) for h in held]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, token, df) of the shingles that several sets have; all rows of a shingle come to one task."""
    token, name = _columns(batches, ("token", "set"))
    order = np.lexsort((name, token))
    token, name = token[order], name[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
    token, name = token[new], name[new]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    df = np.diff(np.concatenate([starts, [len(token)]]))
    df = np.repeat(df, df)
    for at in range(0, len(token), 1 << 16):
        part = slice(at, at + (1 << 16))
        keep = df[part] > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[part][keep]), pa.array(token[part][keep]), pa.array(df[part][keep].astype(np.int64))], names=["set", "token", "df"]
        )


def _met(percent: int) -> Callable:
    """(token, leader, set, near) of the members of each list but the leader; not ``near`` where their block is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, name, n, place, own = _columns(batches, ("token", "set", "n", "place", "own"))
        order = np.lexsort((name, own, token))
        token, name, n, place, own = (c[order] for c in (token, name, n, place, own))
        first = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
        leader = np.flatnonzero(first)[np.cumsum(first) - 1]
        # A block is a run of members with equal size and place in a list.
        order = np.lexsort((place, n, leader))
        edges = np.stack([leader[order], n[order], place[order]])
        begins = np.flatnonzero(np.concatenate([[True], (edges[:, 1:] != edges[:, :-1]).any(axis=0)])[: len(order)])
        head, size, at = edges[:, begins]
        head_size, head_at = n[head], place[head]
        fits = 100 * np.minimum(size, head_size) >= percent * np.maximum(size, head_size)
        # The first common shingle leaves both with enough behind it.
        both = np.minimum(size - at, head_size - head_at) + 1
        fits &= both * (100 + percent) >= percent * (size + head_size)
        near = np.zeros(len(token), bool)
        near[order] = np.repeat(fits, np.diff(np.concatenate([begins, [len(order)]])))
        rest = ~first
        columns = [token[rest], name[leader][rest], name[rest], near[rest]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "leader", "set", "near"])

    return run


def _by_token(rows: DataFrame, n_rows: int) -> DataFrame:
    return rows.repartition(max(partitions(rows), -(-n_rows // _PART_ROWS)), "token")


def _with_leader(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the leader's shingles to (leader, set, …); the rows of a much-followed one are spread over copies of it."""
    followed = written(rows.groupBy("leader").agg(F.count(F.lit(1)).alias("__n")).withColumn("copies", F.ceil(F.col("__n") / _LEADER_ROWS)), "leaders")
    copied = followed.join(sets.select(F.col("set").alias("leader"), F.col("shingles").alias("theirs")), "leader")
    copied = copied.select("leader", "theirs", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    salted = lookup_join(rows, followed.select("leader", "copies", "__n"), "leader")
    salted = salted.withColumn("copy", F.pmod(F.xxhash64("set"), F.col("copies")) + 1).drop("copies")
    return salted.join(copied, ["leader", "copy"]).drop("copy")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(leader, set, linked) of pairs, by their whole sets."""
    pairs = written(pairs, "pairs")
    own = sets.select("set", F.col("shingles").alias("mine"))
    both = F.size(F.array_intersect("mine", "theirs"))
    sized = _with_leader(pairs, sets).join(own, "set").select("leader", "set", both.alias("both"), (F.size("mine") + F.size("theirs")).alias("sum"))
    told = sized.select("leader", "set", (F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).alias("linked"))
    return written(told, "compared")


def _matrix(x: np.ndarray, x_row: np.ndarray, y: np.ndarray, y_row: np.ndarray, n_x: int, n_y: int) -> np.ndarray:
    """How many values each row of x has in common with each row of y."""
    values = np.intersect1d(x, y)
    sides = []
    for side, row in ((x, x_row), (y, y_row)):
        column = np.searchsorted(values, side)
        hit = (column < len(values)) & (values[np.minimum(column, len(values) - 1)] == side) if len(values) else np.zeros(len(side), bool)
        sides.append((column[hit], row[hit]))
    total = np.zeros((n_x, n_y), np.int64)
    for at in range(0, len(values), _COLUMNS):
        tables = []
        for (column, row), n in zip(sides, (n_x, n_y)):
            here = (column >= at) & (column < at + _COLUMNS)
            table = np.zeros((n, min(_COLUMNS, len(values) - at)), np.float32)
            table[row[here], column[here] - at] = 1
            tables.append(table)
        total += (tables[0] @ tables[1].T).astype(np.int64)
    return total


def _derived(percent: int) -> Callable:
    """(a, b): for each seeker of a block one link to each class that a member of the other block has."""

    def side(sets: pa.StructArray) -> tuple[np.ndarray, ...]:
        names, roots, n = (sets.field(c).to_numpy() for c in ("set", "root", "n"))
        parts = []
        for c in ("lacks", "extras"):
            lists = sets.field(c)
            parts.append((lists.flatten().to_numpy(), np.repeat(np.arange(len(sets)), pa.compute.list_value_length(lists).to_numpy())))
        return names, roots, n, *parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                led = batch.column("led")[i].as_py()
                x_names, x_roots, x_n, x_lacks, x_extras = side(batch.column("seekers")[i].values)
                y_names, y_roots, y_n, y_lacks, y_extras = side(batch.column("members")[i].values)
                n_x, n_y = len(x_names), len(y_names)
                lacks = np.bincount(x_lacks[1], minlength=n_x)[:, None] + np.bincount(y_lacks[1], minlength=n_y)[None, :]
                both = led - lacks + _matrix(*x_lacks, *y_lacks, n_x, n_y) + _matrix(*x_extras, *y_extras, n_x, n_y)
                linked = (both * 100 >= (x_n[:, None] + y_n[None, :] - both) * percent) & (x_roots[:, None] != y_roots[None, :])
                a, b = np.nonzero(linked)
                _, one = np.unique(np.stack([a, y_roots[b]]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(x_names[a[one]]), pa.array(y_names[b[one]])], names=["a", "b"])

    return run


def _links_of_rest(met: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between members of a list that are in different classes after all were compared with their leaders."""
    roots = components(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), links).withColumnRenamed("id", "set")
    rooted = met.select("token", "set").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    tally = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    lists = tally.groupBy("token").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("classes"))
    lists = lists.filter("classes > 1").select("token", F.col("top.root").alias("team"))
    members = written(rooted.join(lists, "token").select("team", "set", "root").distinct(), "members")
    if members.isEmpty():
        return None
    # The leader of a team is a set of its largest class; every member is told by how it differs from it.
    led = members.groupBy("team").agg(F.min(F.struct((F.col("root") != F.col("team")).alias("other"), "set")).alias("one"))
    members = lookup_join(members, written(
        led.join(members.groupBy("team").agg(F.count(F.lit(1)).alias("__n")), "team").select("team", F.col("one.set").alias("leader"), "__n"), "teams"
    ), "team")
    own = sets.select("set", F.col("shingles").alias("mine"))
    told = _with_leader(written(members, "members"), sets).join(own, "set").select(
        "team", "set", "root", F.size("mine").alias("n"), F.size("theirs").alias("led"),
        F.array_except("theirs", "mine").alias("lacks"), F.array_except("mine", "theirs").alias("extras"),
    )
    # Bands of sizes a link apart: sets of bands that do not touch are never linked.
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100) + 1e-9).cast("int")
    told = written(told.withColumn("band", band), "told")

    def blocks(side: DataFrame, name: str) -> DataFrame:
        numbers = side.groupBy("team", "band").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
        placed = side.join(numbers, ["team", "band"]).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))
        one = F.struct("set", "root", "n", "lacks", "extras")
        return placed.groupBy("team", "band", "block").agg(F.max("led").alias("led"), F.collect_list(one).alias(name))

    asking = written(blocks(told.filter("root <> team"), "seekers"), "asking").drop("led")
    asking = asking.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    asked = written(blocks(told, "members"), "asked").withColumnRenamed("block", "other")
    pairs = asking.join(asked, ["team", "band"]).repartition(partitions(met), "team", "band", "block", "other").select("led", "seekers", "members")
    return written(pairs.mapInArrow(_derived(percent), "a bigint, b bigint").distinct(), "links")


def _candidates(sets: DataFrame, n_rows: int, percent: int) -> DataFrame:
    """The index rows (token, set, n, place, own) of (set, n, shingles); ``own`` is how many no other set has.

    Sets that have too many shingles of their own to be linked go, until that leaves few more without partners.
    """
    while True:
        shared = _by_token(sets.select("set", F.explode("shingles").alias("token")), n_rows).mapInArrow(_shared, "set bigint, token bigint, df bigint")
        shared = written(shared, "shared")
        with_others = shared.groupBy("set").agg(F.count(F.lit(1)).alias("others"))
        kept = sets.join(with_others, "set").filter(F.col("others") * 100 >= F.col("n") * percent)
        kept = written(kept.select("set", "n", (F.col("n") - F.col("others")).alias("own"), "shingles"), "kept")
        before, row = n_rows, kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        n_rows = row.n
        if n_rows > 0.9 * before or n_rows == 0:
            break
        sets = kept.drop("own")
    by_rarity = F.array_sort(F.collect_list(F.struct("df", "token")))
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("own")
    ordered = shared.join(kept.select("set", "n", "own"), "set").groupBy("set", "n", "own").agg(by_rarity.alias("tokens"))
    prefix = ordered.select("set", "n", "own", F.posexplode(F.slice("tokens", F.lit(1), needed.cast("int"))).alias("at", "one"))
    return prefix.select("one.token", "set", "n", (F.col("own") + F.col("at") + 1).alias("place"), "own")


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id) of each row: its class by links of shingle sets, named by the smallest id.

    A text's set has its distinct shingles of ``width`` words (A-Z lower-cased); a shorter text is one shingle. Two
    rows are linked where 100 times the intersection of their sets is at least ``percent`` times the union. A text
    that is null, empty or without words has an empty set, is linked with nothing and is its own class. Rows with
    equal sets are one class; rows with equal ids and different texts are judged by their texts. A row with a null id
    links nothing and its class is null. Other columns are not read; an empty table gives an empty result.
    """
    lean = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    named = written(lean.mapInArrow(_sized(width), "id bigint, set bigint, n bigint"), "sets")
    known = named.filter("n > 0 and id is not null")
    classes = written(known.groupBy("set").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("__n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n

    some = lean.filter("id is not null")
    n_prefix = int(total * 2 * (1 - percent / 100)) + 1
    first = _by_token(some.mapInArrow(_prefixes(width, percent), "token bigint, set bigint"), n_prefix)
    shared = written(first.mapInArrow(_shared, "set bigint, token bigint, df bigint"), "prefixes")
    # A partner may be smaller, and then shares no more than its own prefix has to.
    smallest = F.ceil(F.col("n") * percent / 100)
    must = F.greatest(F.floor(smallest * (100 - percent) / 100), F.lit(1))
    alive = shared.groupBy("set").agg(F.count(F.lit(1)).alias("others")).join(classes, "set").filter(F.col("others") >= must)
    alive = written(alive.select("set", "id", "n"), "alive")
    read = with_ids(some, written(alive.select("id").distinct(), "ids"), "id").mapInArrow(_whole(width), "set bigint, shingles array<bigint>")
    sets = written(read.dropDuplicates(["set"]).join(alive.select("set", "n"), "set"), "shingles")
    n_rows = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n

    index = written(_candidates(sets, n_rows, percent), "index")
    met = written(_by_token(index, index.count()).mapInArrow(_met(percent), "token bigint, leader bigint, set bigint, near boolean"), "met")
    told = _compared(met.filter("near").select("leader", "set").distinct(), sets, percent)
    links = written(told.filter("linked").select(F.col("leader").alias("a"), F.col("set").alias("b")), "links")
    more = _links_of_rest(met, links, sets, percent)
    edges = links if more is None else written(links.unionAll(more), "links")
    roots = components(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges)
    rooted = classes.join(roots.withColumnRenamed("id", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    smallest_id = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    table = written(rooted.join(smallest_id, "root").select("set", "component_id", "__n"), "classes")
    judged = lookup_join(named, table, "set")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return judged.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.cast("bigint").alias("component_id"))
