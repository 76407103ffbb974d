"""Per-column counts: rows, missing, distinct (A9) from one scan and one pre-aggregated shuffle.

``count(DISTINCT a), count(DISTINCT b), ...`` in one aggregate ships every row once per column with all
columns on board. Here each cell becomes one narrow (position, value) row that is combined on the map
side before it is shuffled, so copies of a hot value collapse where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kinds import BOOLEAN, DATETIME, NESTED, NUMERIC, as_double, col, kind_of, kinds
from ..functions.scalars import epoch_micros

# Distinct counts at which some rule of the package changes its answer.
DECISION_COUNTS = (1, 2, 5, 10, 15, 20, 50)
DECISION_RATIOS = (0.05, 0.98, 0.999, 1.0)
_HLL_ERROR = 0.05


@dataclass(frozen=True)
class ColumnTally:
    name: str
    position: int
    dtype: str
    kind: str
    n_rows: int
    n_missing: int
    n_unique: int
    exact: bool = True

    @property
    def numeric(self) -> bool:
        """Numeric in the planning sense."""
        return self.kind in (NUMERIC, BOOLEAN)

    @property
    def missing_ratio(self) -> float:
        return self.n_missing / max(self.n_rows, 1)

    @property
    def unique_ratio(self) -> float:
        return self.n_unique / max(self.n_rows, 1)


@dataclass(frozen=True)
class TableTally:
    n_rows: int
    columns: tuple[ColumnTally, ...]

    def __getitem__(self, name: str) -> ColumnTally:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def __contains__(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    def without(self, names) -> "TableTally":
        gone = set(names)
        return TableTally(self.n_rows, tuple(c for c in self.columns if c.name not in gone))


def _cell(df: DataFrame, field: T.StructField, position: int) -> Column:
    """One cell as (position, whole, real, text); only the slot of its type is filled."""
    kind = kind_of(field.dataType)
    whole = F.lit(None).cast("bigint")
    real = F.lit(None).cast("double")
    text = F.lit(None).cast("string")
    if isinstance(field.dataType, T.IntegralType):
        whole = col(field.name).cast("bigint")
    elif kind == BOOLEAN:
        whole = col(field.name).cast("int").cast("bigint")
    elif kind == DATETIME:
        whole = epoch_micros(col(field.name))
    elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        real = as_double(df, field.name)
    elif kind == NESTED:
        text = F.to_json(F.struct(col(field.name)))
        text = F.when(col(field.name).isNotNull(), text)
    else:
        text = col(field.name).cast("string")
    return F.struct(
        F.lit(position).alias("position"), whole.alias("whole"), real.alias("real"), text.alias("text")
    )


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, whole, real, text, n): how often each value of each column occurs, missing included."""
    wanted = df.columns if columns is None else columns
    cells = [_cell(df, f, i) for i, f in enumerate(df.schema.fields) if f.name in set(wanted)]
    return (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .groupBy("position", "whole", "real", "text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _column_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column from the schema; its size is the width of the table."""
    rows = [
        (i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
        if f.name in set(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, kind string")


def tally_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, dtype, kind, n_rows, n_missing, n_unique), exact, as one lazy plan."""
    wanted = list(df.columns) if columns is None else columns
    present = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
    counted = (
        value_counts(df, wanted)
        .groupBy("position")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(~present, F.col("n")).otherwise(0)).alias("n_missing"),
            F.sum(F.when(present, 1).otherwise(0)).alias("n_unique"),
        )
    )
    # Both sides have one row per column of the table.
    return (
        _column_frame(df, wanted)
        .join(F.broadcast(counted), "position", "left")
        .na.fill(0, ["n_rows", "n_missing", "n_unique"])
    )


def approx_tally(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The same columns with sketched distinct counts: one scan and no shuffle of values."""
    wanted = list(df.columns) if columns is None else columns
    known = kinds(df)
    fields = []
    for i, f in enumerate(df.schema.fields):
        if f.name not in set(wanted):
            continue
        c = as_double(df, f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name)
        if known[f.name] == NESTED:
            c = F.when(c.isNotNull(), F.to_json(F.struct(c)))
        fields.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(known[f.name]).alias("kind"),
                F.count(F.lit(1)).alias("n_rows"),
                (F.count(F.lit(1)) - F.count(c)).alias("n_missing"),
                F.approx_count_distinct(c, _HLL_ERROR).alias("n_unique"),
            )
        )
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, dtype string, kind string, n_rows long, n_missing long, n_unique long"
        )
    return df.agg(F.array(*fields).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def _near_decision(n_unique: int, n_rows: int) -> bool:
    slack = 4 * _HLL_ERROR
    if n_unique <= max(DECISION_COUNTS) * (1 + slack) + 1:
        return True
    ratio = n_unique / max(n_rows, 1)
    return any(abs(ratio - line) <= slack * line for line in DECISION_RATIOS) or ratio >= 1 - slack


def collect_tally(df: DataFrame, screened: bool = False) -> TableTally:
    """One small row per column on the driver.

    ``screened=True`` sketches every distinct count first and counts exactly only the columns whose
    sketch lies near a line where a rule would change its mind; the others keep the sketch.
    """
    if not screened:
        rows = tally_frame(df).orderBy("position").collect()
        if not rows:
            return TableTally(df.count(), ())
        return TableTally(
            max(r.n_rows for r in rows),
            tuple(
                ColumnTally(r.column, r.position, r.dtype, r.kind, r.n_rows, r.n_missing, r.n_unique) for r in rows
            ),
        )
    rough = approx_tally(df).orderBy("position").collect()
    if not rough:
        return TableTally(df.count(), ())
    unsure = [r.column for r in rough if _near_decision(r.n_unique, r.n_rows)]
    exact = {r.column: r.n_unique for r in tally_frame(df, unsure).collect()} if unsure else {}
    return TableTally(
        rough[0].n_rows,
        tuple(
            ColumnTally(
                r.column, r.position, r.dtype, r.kind, r.n_rows, r.n_missing,
                exact.get(r.column, r.n_unique), r.column in exact,
            )
            for r in rough
        ),
    )


def n_unique(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, n_unique) of non-missing values."""
    source = approx_tally(df, columns) if approx else tally_frame(df, columns)
    return source.select("column", "n_unique")
