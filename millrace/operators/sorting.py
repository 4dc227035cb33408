"""Sorts by two keys with sentinels last in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cutting import cut

#: Values that stand for "unknown" and sort last.
SENTINELS = {"population": -1, "activity": "-", "latency": -1}
FLAGS = ("flag8", "flag4", "flag2", "flag1")


def world_key(name: str, ascending: bool) -> Column:
    """A sort key: a column, sentinels as nulls, or flagN, a bit of ``flags``."""
    if name in FLAGS:
        key = F.col("flags").bitwiseAND(F.lit(int(name[4:]))) != 0
    else:
        key = F.nullif(F.col(name), F.lit(SENTINELS[name])) if name in SENTINELS else F.col(name)
    return key.asc_nulls_last() if ascending else key.desc_nulls_last()


def place(rows: DataFrame, *order) -> DataFrame:
    """Rows with their rank from 1: sorted in ranges of the order, each range's rows counted, and ranks made from the counts before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    base, at = [], 0
    for r in ranged.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row for each partition
        base.append((r.p, at))
        at += r["count"]
    before = F.broadcast(rows.sparkSession.createDataFrame(base, "__part long, __before long"))
    placed = ranged.join(before, part == F.col("__part"))
    return placed.withColumn("place", (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__id", "__part", "__before")


def world_sort(rows: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Rows ranked by up to two ``(name, ascending)`` keys, then by id."""
    return place(rows, *[world_key(n, up) for n, up in keys], "id")
