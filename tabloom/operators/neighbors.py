"""Exact k nearest neighbours (M4) and the local outlier factor (M16; Breunig et al., 2000)."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kinds import col
from ..session import written
from .blocks import Cells, NearPairs, block_join, chunks, distances, distinct_vectors, matrix, vector_array
from .isolation import flag_anomalies
from .lookup import lookup_join

_TINY = 1e-10
# Pairs within the bounds that a block holds before the nearest are taken out and the bounds shrink.
_HELD = 200_000


def _best(k: int, same: bool, payload: tuple[str, ...]):
    """Block work: the nearest points of each query until their weights reach k."""

    def work(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(queries["vec"]), matrix(points["vec"])
        qid, pid = queries["id"].to_numpy(), points["id"].to_numpy()
        weight = points["weight"].to_numpy(dtype=np.int64)
        take = min(k + int(same), len(b))
        rows, picks, far, used = [], [], [], []
        for part in chunks(len(a), len(b)):
            d = distances(a[part], b)
            # Ties go to the smaller id, so that every block and every run agrees.
            kth = np.partition(d, take - 1, axis=1)[:, take - 1]
            for i in range(len(d)):
                near = np.flatnonzero(d[i] <= kth[i])
                near = near[np.lexsort((pid[near], d[i][near]))][:take]
                w = weight[near] - ((pid[near] == qid[part.start + i]) if same else 0)
                near, w = near[w > 0], w[w > 0]
                before = np.cumsum(w) - w
                near, w = near[before < k], w[before < k]
                rows += [qid[part.start + i]] * len(near)
                picks.append(near)
                far.append(d[i][near])
                used.append(w)
        flat = np.concatenate(picks) if picks else np.array([], dtype=int)
        out = pd.DataFrame(
            {
                "id": rows,
                "pid": pid[flat],
                "distance": np.concatenate(far) if far else [],
                "weight": np.concatenate(used) if used else [],
            }
        )
        for name in payload:
            out[name] = points[name].to_numpy()[flat]
        return out

    return work


def _nearer(k: int, same: bool, payload: tuple[str, ...]):
    """Block work: as :func:`_best`, among the points that lie within ``limit`` of a query in a cell it has ``open``."""

    def work(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("place", kind="stable")
        a, b = matrix(queries["vec"]), matrix(points["vec"])
        qid, pid = queries["id"].to_numpy(), points["id"].to_numpy()
        weight = points["weight"].to_numpy(dtype=np.int64)
        opened, bound = queries["open"].to_numpy(dtype=np.int64), queries["limit"].to_numpy(dtype=float).copy()
        pairs = NearPairs(a, b)

        def nearest_of(row: np.ndarray, at: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
            """The nearest of each row until their weights reach k; ties go to the smaller id."""
            w = weight[at] - (pid[at] == qid[row] if same else 0)
            order = np.lexsort((pid[at], far, row))
            order = order[w[order] > 0]
            row, at, far, w = row[order], at[order], far[order], w[order]
            upto = np.cumsum(w)
            starts = np.searchsorted(row, row)
            before = upto - w - (upto - w)[starts]
            kept = before < k
            full = (before + w >= k) & kept
            bound[row[full]] = np.minimum(bound[row[full]], far[full])
            return row[kept], at[kept], far[kept], w[kept]

        found, held = [], 0
        place = points["place"].to_numpy()
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        for start, end in zip(starts.tolist(), np.append(starts[1:], len(place)).tolist()):
            asking = np.flatnonzero(opened >> np.int64(place[start]) & 1)
            for more in pairs.within(asking, slice(start, end), bound):
                found.append(more)
                held += len(more[0])
                if held > max(_HELD, 4 * k * len(a)):
                    found = [nearest_of(*(np.concatenate(x) for x in zip(*found)))[:3]]
                    held = len(found[0][0])
        none = np.zeros(0, np.int64)
        row, at, far, w = nearest_of(*(np.concatenate(x) for x in zip(*found))) if found else (none, none, none.astype(float), none)
        out = pd.DataFrame({"id": qid[row], "pid": pid[at], "distance": far, "weight": w})
        for name in payload:
            out[name] = points[name].to_numpy()[at]
        return out

    return work


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The nearest of all blocks per query; ``weight`` becomes the copies that count towards k."""
    order = Window.partitionBy("id").orderBy("distance", "pid")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        first.withColumn("before", F.coalesce(F.sum("weight").over(running), F.lit(0)))
        .filter(F.col("before") < k)
        .withColumn("weight", F.least(F.col("weight"), F.lit(k) - F.col("before")))
        .drop("before")
    )


def nearest(
    queries: DataFrame,
    cells: Cells,
    placed: DataFrame,
    k: int,
    same: bool = False,
    payload: tuple[str, ...] = (),
) -> DataFrame:
    """(id, rank, pid, distance, weight, …payload): the exact k nearest points of each query.

    ``queries`` has (id, vec). With ``same`` both sides are one set and a point is not its own neighbour,
    though its copies are. A first pass in the home cell bounds the distance; a second one visits only
    the cells that can hold something nearer. Neighbouring cells share a shelf, to which a query goes once.
    """
    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(
        ["id bigint", "pid bigint", "distance double", "weight bigint", *[f"{c} {types[c]}" for c in payload]]
    )
    lean = placed.select("id", "vec", "weight", "cell", *payload)
    at_home = written(
        queries.select("id", "vec", cells.home(queries).alias("home")), "queries"
    )
    work = _best(k, same, payload)
    first = written(
        _merge(block_join(at_home.withColumn("cells", F.array("home")), lean, cells.block, work, schema), k), "near"
    )
    if cells.single:
        return first
    bound = first.groupBy("id").agg(F.max("distance").alias("limit"), F.sum("weight").alias("have"))
    # Short of k neighbours nothing can be ruled out yet.
    bounded = at_home.join(bound, "id", "left").withColumn(
        "limit", F.when(F.col("have") >= k, F.col("limit")).otherwise(F.lit(float("inf")))
    )
    width, block = cells.shelves(queries.count(), placed.count(), placed.sparkSession.sparkContext.defaultParallelism)
    open_shelves = cells.reach_shelves(bounded, F.col("limit"), F.col("home"), width)
    beyond = written(bounded.select("id", "vec", "limit", open_shelves.alias("cells")), "beyond")
    second = block_join(beyond, cells.shelved(lean, width), block, _nearer(k, same, payload), schema)
    return _merge(first.drop("rank").unionByName(second), k)


class NearestNeighbors:
    """M4: classification by the exact k nearest training rows."""

    def __init__(self, k: int = 5, weights: str = "uniform", block: int | None = None):
        self.k, self.weights, self.block = k, weights, block

    def fit(self, df: DataFrame) -> "NearestNeighborsModel":
        cells, placed = Cells.build(distinct_vectors(df, "features", "label"), self.block)
        return NearestNeighborsModel(self.k, self.weights, cells, placed)


class NearestNeighborsModel:
    def __init__(self, k: int, weights: str, cells: Cells, placed: DataFrame):
        self.k, self.weights, self.cells, self.placed = k, weights, cells, placed

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``: the class with most votes, the smallest among equals."""
        asked = distinct_vectors(df, "features")
        near = written(nearest(asked, self.cells, self.placed, self.k, payload=("labels", "counts")), "near")
        # Copies of one point vote with the mix of their classes.
        share = F.col("weight") / F.aggregate("counts", F.lit(0.0), lambda a, v: a + v)
        if self.weights == "distance":
            closest = F.min("distance").over(Window.partitionBy("id"))
            pull = F.when(closest == 0, (F.col("distance") == 0).cast("double")).otherwise(
                F.try_divide(F.lit(1.0), F.col("distance"))
            )
            near = near.withColumn("pull", pull)
            share = share * F.col("pull")
        votes = (
            near.withColumn("share", share)
            .select("id", "share", F.explode(F.arrays_zip("labels", "counts")).alias("c"))
            .groupBy("id", F.col("c.labels").alias("y"))
            .agg(F.round(F.sum(F.col("c.counts") * F.col("share")), 9).alias("votes"))
            .groupBy("id")
            .agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("y"))).alias("best"))
            .select("id", F.col("best.y").alias("prediction"))
        )
        answers = asked.join(votes, "id").select(
            F.col("vec").alias("__vec"), F.col("weight").alias("__n"), "prediction"
        )
        return lookup_join(df.withColumn("__vec", vector_array(df, "features")), answers, "__vec").drop("__vec")

    def save(self, path: str) -> None:
        spark = self.placed.sparkSession
        self.placed.write.parquet(f"{path}/points")
        self.cells.save(spark, f"{path}/nodes")
        state = {"k": self.k, "weights": self.weights}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NearestNeighborsModel":
        s = json.loads(spark.read.text(f"{path}/state").first().value)
        return NearestNeighborsModel(s["k"], s["weights"], Cells.load(spark, f"{path}/nodes"), spark.read.parquet(f"{path}/points"))


def local_outlier_factor(
    df: DataFrame, k: int = 20, features: str = "features", block: int | None = None, output: str = "score"
) -> DataFrame:
    """How much thinner the neighbourhood of a row is than that of its neighbours."""
    points = distinct_vectors(df, features)
    cells, placed = Cells.build(points, block)
    near = written(nearest(points, cells, placed, k, same=True), "graph")
    reach_of = near.groupBy("id").agg(F.max("distance").alias("reach"))
    popular = near.groupBy("pid").agg(F.count(F.lit(1)).alias("__n"))
    # A point can be the neighbour of very many others, hence the skew-safe lookups.
    by_reach = popular.join(reach_of.withColumnRenamed("id", "pid"), "pid")
    with_reach = lookup_join(near.select("id", "pid", "distance", "weight"), by_reach, "pid")
    mean_reach = F.sum(F.greatest("distance", "reach") * F.col("weight")) / F.sum("weight")
    density = written(
        with_reach.groupBy("id").agg((F.lit(1.0) / (mean_reach + F.lit(_TINY))).alias("density")), "density"
    )
    by_density = popular.join(density.withColumnRenamed("id", "pid"), "pid")
    with_density = lookup_join(near.select("id", "pid", "weight"), by_density, "pid")
    around = with_density.groupBy("id").agg(
        (F.sum(F.col("density") * F.col("weight")) / F.sum("weight")).alias("around")
    )
    factor = around.join(density, "id").select("id", (F.col("around") / F.col("density")).alias("factor"))
    # A lone point has no neighbours to compare with.
    answers = points.join(factor, "id", "left").select(
        F.col("vec").alias("__vec"), F.col("weight").alias("__n"), F.coalesce("factor", F.lit(1.0)).alias(output)
    )
    return lookup_join(df.withColumn("__vec", vector_array(df, features)), answers, "__vec").drop("__vec")


class LocalOutlierFactor:
    """M16 as a model: it scores the rows it is fitted on, so ``transform`` takes those rows."""

    def __init__(self, k: int = 20, contamination: float = 0.05):
        self.k, self.contamination = k, contamination

    def fit(self, df: DataFrame) -> "LocalOutlierFactor":
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        scored = written(local_outlier_factor(df, self.k), "scored")
        flagged = flag_anomalies(scored, "score", self.contamination)
        return flagged.withColumn("prediction", F.when(col("is_anomaly"), -1).otherwise(1)).drop("is_anomaly")
