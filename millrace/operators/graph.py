"""Shortest paths on a grid with blocked cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the search for another cell where the target can't be reached.
FALLBACK_REACH, FALLBACK_COST = 10, 100


def grid_costs(spark: SparkSession, cells: DataFrame, start: tuple[int, int], steps: int) -> DataFrame:
    """``(x, y, cost)``: least steps from ``start`` to each free cell of ``cells (x, y)`` within ``steps``, in 8 directions.

    A diagonal step needs both cells beside it free. Breadth first, one frontier join a step, with
    every frontier's lineage cut by a checkpoint each eight steps.
    """
    from .cutting import cut

    around = spark.createDataFrame([(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy], "dx int, dy int")
    free = cut(cells.select("x", "y").distinct())
    reached = spark.createDataFrame([(*start, 0)], "x int, y int, cost int").join(free, ["x", "y"], "left_semi")
    ok = free.withColumn("ok", F.lit(True))
    side = lambda a, b, n: ok.select(F.col("x").alias(a), F.col("y").alias(b), F.col("ok").alias(n))
    front = reached
    for k in range(1, steps + 1):
        near = front.join(F.broadcast(around)).select("x", "y", (F.col("x") + F.col("dx")).alias("nx"), (F.col("y") + F.col("dy")).alias("ny"), "dx", "dy")
        near = near.join(side("nx", "ny", "o1"), ["nx", "ny"]).join(side("nx", "y", "o2"), ["nx", "y"], "left").join(side("x", "ny", "o3"), ["x", "ny"], "left")
        near = near.where((F.col("dx") * F.col("dy") == 0) | (F.col("o2") & F.col("o3"))).select(F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()
        front = near.join(reached, ["x", "y"], "left_anti").withColumn("cost", F.lit(k))
        front = cut(front)
        if front.isEmpty():
            break
        reached = reached.union(front)
        if k % 8 == 0:
            reached = cut(reached)
    return reached


def reach_or_near(costs: DataFrame, target: tuple[int, int]) -> DataFrame:
    """The target's row, or else that of the reached cell nearest to it (then of least cost)."""
    dx, dy = F.col("x") - target[0], F.col("y") - target[1]
    hit = (dx == 0) & (dy == 0)
    near = hit | ((F.abs(dx) <= FALLBACK_REACH) & (F.abs(dy) <= FALLBACK_REACH) & (F.col("cost") < FALLBACK_COST))
    return costs.where(near).withColumn("d2", dx * dx + dy * dy).orderBy("d2", "cost", "x", "y").limit(1)
