"""Exact stratified splits without sorting or moving rows (V1, V2).

Each row has a place in [0, 1). The cut between train and hold-out, or between folds, is an order statistic of the
places within a class. It is found by counting rows per class and bin of places, and looking closer at the bins that
hold a cut, so hot classes cost no more than small ones. Rows with the place of a cut are parted by a number that each
row gets when it is written. The split itself compares a row with the cuts of its class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import col
from ..session import written
from .lookup import lookup_join

# Places are whole numbers of 48 bits, narrowed by 12, 12 and 24 of them.
_BITS = 48
_LEVELS = (12, 12, 24)
_END = 1 << _BITS
# Cuts are broadcast up to this many (four numbers each); beyond it they are joined by a shuffle.
BROADCAST_CUTS = 200_000


def position_of(df: DataFrame, key: Sequence[str] | None = None, seed: int = 42) -> Column:
    """A number in [0, 1) per row, from the hash of its key.

    Without a key it comes from the row's place in the table, so it belongs to one evaluation: write it with the rows.
    """
    parts = [col(c) for c in key] if key else [F.monotonically_increasing_id()]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(_END)) / F.lit(float(_END))


def _near(cuts: DataFrame) -> DataFrame:
    return F.broadcast(cuts) if cuts.count() <= BROADCAST_CUTS else cuts


def _locate(data: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, j, cut, rest): the place at 0-based ``rank`` of each class in ``data`` (s, i), and how many of the rows at
    that place come before the rank. ``wanted`` has (s, j, rank)."""
    found = wanted.select("s", "j", "rank", F.lit(0).cast("long").alias("prefix"))
    left = _BITS
    for level, bits in enumerate(_LEVELS):
        shift = left - bits
        if level:
            inside = data.withColumn("prefix", F.shiftright("i", left)).join(_near(found), ["s", "prefix"])
            bins = inside.groupBy("s", "j", "rank", F.shiftright("i", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            running = Window.partitionBy("s", "j").orderBy("bin")
            upto = bins.withColumn("upto", F.sum("n").over(running))
        else:
            # A window over at most 4,096 bins of a class.
            bins = data.groupBy("s", F.shiftright("i", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("bin"))).join(found, "s")
        hit = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))
        rest = F.col("rank") - (F.col("upto") - F.col("n"))
        found = written(upto.filter(hit).select("s", "j", rest.alias("rank"), F.col("bin").alias("prefix")), "cuts")
        left = shift
    return found.select("s", "j", F.col("prefix").alias("cut"), F.col("rank").alias("rest"))


def _below(
    df: DataFrame, position: Column, fractions: Sequence[float], stratum: Column | None, seed: int
) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with the cuts of each row's class; for each fraction whether a row is among the first
    floor(fraction * rows) of its class; the names of the helper columns."""
    s = F.lit("") if stratum is None else F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit(""))
    placed = df.withColumn("__s", s).withColumn("__i", F.floor(position * _END).cast("long"))
    data = placed.select(F.col("__s").alias("s"), F.col("__i").alias("i"))
    sizes = written(data.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "sizes")
    ranks = F.array(*[F.struct(F.lit(j).alias("j"), F.floor(F.col("n") * f).alias("rank")) for j, f in enumerate(fractions)])
    wanted = sizes.select("s", "n", F.inline(ranks)).filter("rank < n").select("s", "j", "rank")
    cuts = _locate(data, wanted)
    tied = cuts.filter("rest > 0")
    if tied.isEmpty():
        placed, cuts = placed.withColumn("__q", F.lit(0).cast("long")), cuts.withColumn("q", F.lit(0).cast("long"))
    else:
        number = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(_END))
        placed = written(placed.withColumn("__q", number), "numbered")
        at = _near(tied.select(F.col("s").alias("__s"), "j", F.col("cut").alias("__i"), "rest"))
        ties = placed.select("__s", "__i", "__q").join(at, ["__s", "__i"])
        one = F.concat_ws("/", "j", "__s")
        inner = _locate(
            ties.select(one.alias("s"), F.col("__q").alias("i")),
            tied.select(F.concat_ws("/", "j", "s").alias("s"), "j", F.col("rest").alias("rank")),
        )
        cuts = cuts.withColumn("__js", F.concat_ws("/", "j", "s")).join(inner.select(F.col("s").alias("__js"), F.col("cut").alias("q")), "__js", "left").withColumn("q", F.coalesce("q", F.lit(0)))
    columns = [
        F.max(F.when(F.col("j") == j, F.col(c))).alias(f"__{c}{j}") for j in range(len(fractions)) for c in ("cut", "q")
    ]
    table = sizes.join(cuts, "s", "left").groupBy("s").agg(F.max("n").alias("__n"), *columns).withColumnRenamed("s", "__s")
    marked = lookup_join(placed, written(table, "cut_table"), "__s")
    tests = [
        F.col(f"__cut{j}").isNull() | (F.col("__i") < F.col(f"__cut{j}"))
        | ((F.col("__i") == F.col(f"__cut{j}")) & (F.col("__q") < F.col(f"__q{j}")))
        for j in range(len(fractions))
    ]
    helpers = ["__s", "__i", "__q", *[f"__{c}{j}" for j in range(len(fractions)) for c in ("cut", "q")]]
    return marked, tests, helpers


def _placed(df: DataFrame, key: Sequence[str] | None, position: Column | None, seed: int) -> DataFrame:
    if position is not None:
        return df.withColumn("__place", position)
    placed = df.withColumn("__place", position_of(df, key, seed))
    return placed if key else written(placed, "placed")


def holdout(
    df: DataFrame,
    fraction: float = 0.2,
    stratum: str | None = None,
    key: Sequence[str] | None = None,
    position: Column | None = None,
    seed: int = 42,
    output: str = "is_valid",
) -> DataFrame:
    """V1: mark floor(fraction * rows) of each class as hold-out.

    Rows are placed by the hash of their key; equal keys, or rows without a key, by the order in which they are
    written. Null is a class of its own.
    """
    placed = _placed(df, key, position, seed)
    marked, (below,), helpers = _below(placed, F.col("__place"), [fraction], None if stratum is None else col(stratum), seed)
    return marked.withColumn(output, below).drop("__place", *helpers)


def folds(
    df: DataFrame,
    k: int = 5,
    stratum: str | None = None,
    key: Sequence[str] | None = None,
    position: Column | None = None,
    seed: int = 42,
    output: str = "fold",
) -> DataFrame:
    """V2: a fold number from 0 to k-1; folds of one class differ by at most one row."""
    placed = _placed(df, key, position, seed + 1)
    shares = [j / k for j in range(1, k)]
    marked, below, helpers = _below(placed, F.col("__place"), shares, None if stratum is None else col(stratum), seed)
    fold = sum(((~b).cast("int") for b in below), F.lit(0))
    return marked.withColumn(output, fold).drop("__place", *helpers)
