"""Many grid searches at once: one frontier for all requests, and for each cell the directions that are open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cutting import cut
from .graph import FALLBACK_COST, FALLBACK_REACH

#: Directions by bit: four straight, then four diagonal ones.
AROUND = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1))
_ALL = (1 << len(AROUND)) - 1


def closed_directions(blocked: DataFrame) -> DataFrame:
    """``(x, y, closed)`` of the cells beside ``blocked (x, y)``: a bit for each direction that can't be taken; other cells have all open.

    A direction is closed where it leads into a blocked cell, a diagonal one also where a cell beside it is blocked.
    """
    bits = []  # (from the blocked cell to the cell that minds it, direction)
    for d, (dx, dy) in enumerate(AROUND):
        bits += [(-i, -j, 1 << d) for i, j in {(dx, dy), (dx, 0), (0, dy)} if i or j]
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(b).alias("b")) for i, j, b in bits])
    beside = blocked.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct().select("x", "y", F.explode(shifts).alias("s"))
    return beside.groupBy((F.col("x") + F.col("s.i")).cast("long").alias("x"), (F.col("y") + F.col("s.j")).cast("long").alias("y")).agg(F.bit_or("s.b").alias("closed"))


def grid_searches(requests: DataFrame, blocked: DataFrame, steps: int) -> DataFrame:
    """For each of ``requests (request, sx, sy, tx, ty)`` the end of its shortest path: ``(request, x, y, cost, found)``.

    Paths take at most ``steps`` steps in eight directions around the blocked cells. Where the target isn't reached, the reached cell nearest
    to it counts (then that of least cost, x and y), if it lies within ``FALLBACK_REACH`` both ways and costs less than
    ``FALLBACK_COST``; else x, y and cost are null. A start is reached at cost 0, blocked or not. ``request`` is unique; requests with nulls find nothing.

    Requests of one start and target are one search. All searches go a step in one job; those at their target go no further. A
    frontier's rows are spread by search and place, so no search is one task. Each step is checkpointed, so its plan doesn't grow.
    """
    closed = cut(closed_directions(blocked))
    asked = cut(requests.select("request", *[F.col(c).cast("long").alias(c) for c in ("sx", "sy", "tx", "ty")]))
    ends = ["sx", "sy", "tx", "ty"]
    whole = cut(asked.dropna().groupBy(*ends).agg(F.min("request").alias("request")))  # one request stands for its likes
    front = cut(whole.select("request", F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(0).alias("cost"), "tx", "ty"))
    rings, hit = [front], (F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty"))
    done = front.where(hit).select("request")
    moves = F.array(*[F.struct(F.lit(1 << d).alias("b"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for d, (dx, dy) in enumerate(AROUND)])
    for k in range(1, steps + 1):
        there = front.join(closed, ["x", "y"], "left").withColumn("open", F.lit(_ALL) - F.coalesce("closed", F.lit(0)))
        moved = there.select("request", "x", "y", "tx", "ty", F.explode(F.filter(moves, lambda m: m["b"].bitwiseAND(F.col("open")) != 0)).alias("m"))
        near = moved.select("request", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), "tx", "ty").distinct()
        # a step leads to the ring before, to its own or to the next one, never further back
        seen = reduce(DataFrame.unionByName, [r.select("request", "x", "y") for r in rings[-2:]])
        fresh = near.join(seen, ["request", "x", "y"], "left_anti").join(done, "request", "left_anti")
        front = cut(fresh.select("request", "x", "y", F.lit(k).alias("cost"), "tx", "ty"))
        if front.isEmpty():
            break
        rings.append(front)
        done = cut(done.unionByName(front.where(hit).select("request")))
    reached = reduce(DataFrame.unionByName, rings)
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    close = hit | ((F.abs(dx) <= FALLBACK_REACH) & (F.abs(dy) <= FALLBACK_REACH) & (F.col("cost") < FALLBACK_COST))
    best = reached.where(close).groupBy("request").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "cost", "x", "y")).alias("e"))
    found = best.select("request", F.col("e.x").alias("x"), F.col("e.y").alias("y"), F.col("e.cost").alias("cost"), (F.col("e.d2") == 0).alias("found"))
    found = whole.join(found, "request").drop("request")
    told = asked.join(found, ends, "left").select("request", *[F.when(F.col("request").isNotNull(), F.col(c)).alias(c) for c in ("x", "y", "cost", "found")])
    return told.withColumn("found", F.coalesce("found", F.lit(False)))
