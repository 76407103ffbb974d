"""Connected components by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .lookup import lookup_join

# Edges that a task of a round takes.
TASK_ROWS = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    ).select("e.*")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks than rows of that number need."""
    return df.coalesce(-(-rows // TASK_ROWS) or 1)


def _star(links: DataFrame, keep: Column, rows: int) -> tuple[DataFrame, DataFrame]:
    """Hang the kept neighbours of every node, and the node itself, on its smallest neighbour."""
    smallest = links.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("root"), F.count(F.lit(1)).alias("__n"))
    smallest = written(_few(smallest, rows), "roots")
    # The centre of a star has very many links, hence the balanced lookup.
    hung = lookup_join(links, smallest, "u").filter(keep).select(F.col("v").alias("a"), F.col("root").alias("b"))
    return hung, smallest


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root): the smallest vertex reachable from each vertex.

    ``vertices`` has (id), ``edges`` has (a, b) in any direction. Rounds grow with the logarithm of the
    longest chain; each one is written to the shared folder, so its history stays short. The edges are counted
    once, since a round never adds any, and decide the number of tasks.
    """
    current = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    rows = 2 * current.count()
    mark = None
    for _ in range(max_rounds):
        large, _ = _star(_both_ways(current), F.col("v") > F.col("u"), rows)
        large = written(_few(large.filter("a <> b").distinct(), rows), "edges")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        hung, smallest = _star(down, F.lit(True), rows)
        small = hung.unionByName(smallest.select(F.col("u").alias("a"), F.col("root").alias("b")))
        current = written(_few(small.filter("a <> b").distinct(), rows), "edges")
        state = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.groupBy("a").agg(F.min("b").alias("root"))
    return vertices.join(roots, vertices.id == roots.a, "left").select(
        vertices.id, F.coalesce("root", vertices.id).alias("root")
    )
