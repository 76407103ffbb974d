"""Mix sources to target weights by capped water-filling; DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup_join
from ..session import written
from .common import WORD

# A seeded order of the documents: 48 bits, cut in steps of 12 bits, so that no window holds more than 4,096 bins
# and, after two steps, a sixteen-millionth of a source.
_STEP = 12
_BITS = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def cyclic_weights(sources: DataFrame, pattern: tuple[int, ...]) -> DataFrame:
    """Give ``sources`` (key, ...) the weights of ``pattern`` in turn, in the order of the key.

    Ranks come from a range partition and per-partition offsets, so no task sorts all sources.
    """
    placed = sources.repartitionByRange("key").sortWithinPartitions("key")
    # The id holds the partition in its upper bits and the row's place in the lower 33.
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weights = F.array(*[F.lit(float(w)) for w in pattern])
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(before), "part")
        .withColumn("weight", F.element_at(weights, (rank % len(pattern) + 1).cast("int")))
        .drop("at", "part", "before")
    )


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``sources`` (key, source_size, weight).

    Targets share ``total`` by weight; one above ``max_epochs`` times its source's size is clamped there and the
    excess is shared again among the rest until none is above. Where all are clamped the total is not reached.
    Each round takes three sums to the driver.
    """
    cap = F.col("source_size") * max_epochs
    level = float("inf")
    clamped = -1
    # Sources clamped at a level stay clamped at the higher level of the next round.
    free = F.lit(True)
    while True:
        sums = sources.agg(
            F.sum(F.when(~free, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(free, F.col("weight")).otherwise(0.0)).alias("weight"),
            F.count(F.when(~free, 1)).alias("clamped"),
        ).first()
        if sums.clamped == clamped or not sums.weight:
            break
        level, clamped = (total - sums.held) / sums.weight, sums.clamped
        free = F.col("weight") * level <= cap
    return sources.withColumn("target", F.least(cap, F.col("weight") * level) if level != float("inf") else cap)


def _cuts(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, cut): the last place in the seeded order whose documents are taken once more.

    Bins of places are summed first, then only the bin that the cut falls into is looked at more closely.
    """
    spec = Window.partitionBy("key").orderBy("bin")
    cuts = targets.select("key", "need", F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("prefix"), "__n")
    for level in range(3):
        shift = _BITS - _STEP * (level + 1) if level < 2 else 0
        width = _STEP if level < 2 else _BITS - 2 * _STEP
        inside = lookup_join(docs, cuts, "key").filter(
            F.shiftright("place", shift + width) == F.col("prefix") if level else F.col("need") > 0
        )
        bins = inside.groupBy("key", "need", "below", F.shiftright("place", shift).alias("bin")).agg(
            F.sum("size").cast("double").alias("size"), F.count(F.lit(1)).alias("__n")
        )
        summed = bins.withColumn("end", F.col("below") + F.sum("size").over(spec))
        if level < 2:
            met = (F.col("end") > F.col("need")) & (F.col("end") - F.col("size") <= F.col("need"))
            cuts = written(
                summed.filter(met).select(
                    "key", "need", (F.col("end") - F.col("size")).alias("below"), F.col("bin").alias("prefix"), "__n"
                ), "cuts",
            )
        else:
            last = summed.filter(F.col("end") - F.col("size") / 2 <= F.col("need"))
            found = last.groupBy("key").agg(F.max("bin").alias("cut"))
            start = F.shiftleft("prefix", width) - 1
            cuts = cuts.join(found, "key", "left").select("key", F.coalesce("cut", start).alias("cut"))
    return cuts


def _place(key: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def mix_plan(
    docs: DataFrame,
    pattern: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The documents as (id, key, size, place), and for each source (key, source_size, target, whole, cut, __n)."""
    sized = written(
        docs.select(
            F.col(id_column).alias("id"),
            source_key(F.col(source_column)).alias("key"),
            word_count(F.col(text_column)).alias("size"),
            _place(F.col(id_column), seed).alias("place"),
        ), "sized",
    )
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n"))
    weighted = written(cyclic_weights(sources, pattern), "weights")
    total = share * (weighted.agg(F.sum("source_size").alias("n")).first().n or 0)
    epochs = F.floor(F.try_divide("target", F.col("source_size")))
    targets = written(
        water_fill(weighted, total, max_epochs)
        .withColumn("whole", F.coalesce(epochs, F.lit(0)))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets",
    )
    table = targets.join(_cuts(sized, targets), "key", "left").select(
        "key", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), "__n"
    )
    return sized, written(table, "mix")


def _copies() -> Column:
    return (F.col("whole") + F.when(F.col("place") <= F.col("cut"), 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for each document; options as in :func:`mix_plan`.

    Size counts words. Sources in code point order, null last, weigh ``pattern`` in turn and share ``share`` times
    all words by :func:`water_fill`. A source whose target is e epochs takes each document floor(e) times, and once
    more the documents that come first in an order seeded by the id until their words come nearest the rest:
    the source misses its target by at most half a document. Documents with equal ids in a source are taken alike.
    Null texts have size 0; a null id is an id of its own; empty tables give empty results. No document is taken
    more than ceil(``max_epochs``) times.
    """
    sized, table = mix_plan(docs, id_column=id_column, **options)
    return (
        lookup_join(sized, table, "key")
        .withColumn("copies", _copies())
        .select(
            F.col("id").alias(id_column), "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def with_copies(
    docs: DataFrame, column: str = "copies", id_column: str = "doc_id", source_column: str = "source", seed: int = 17, **options
) -> DataFrame:
    """Add how often the mix takes each document; rows keep their columns and stay in their tasks unless sources are
    very many."""
    _, table = mix_plan(docs, id_column=id_column, source_column=source_column, seed=seed, **options)
    names = {c: f"__mix_{c}" for c in ("key", "whole", "cut")}
    lean = table.select(*[F.col(c).alias(n) for c, n in names.items()], "__n")
    keyed = docs.withColumn("__mix_key", source_key(F.col(source_column)))
    taken = F.when(_place(F.col(id_column), seed) <= F.col("__mix_cut"), 1).otherwise(0)
    return lookup_join(keyed, lean, "__mix_key").withColumn(column, (F.col("__mix_whole") + taken).cast("long")).drop(*names.values())
