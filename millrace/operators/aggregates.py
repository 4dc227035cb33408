"""Container sums, first maxima, whole percents, boxes and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.int32 import wrap32


def container_counts(slots: DataFrame, wanted: Column, empty: Column, capacity: int) -> DataFrame:
    """By container of ``slots (container, item, qty)``: the wanted items' quantity, and the free slots."""
    return slots.groupBy("container").agg(
        F.coalesce(F.sum(F.when(wanted, F.col("qty"))), F.lit(0)).cast("long").alias("qty"), (capacity - F.count("*") + F.count_if(empty)).cast("int").alias("free")
    )


def wrapped_sums(slots: DataFrame, wanted: Column) -> DataFrame:
    """By container of ``slots (container, item, qty)``: the wanted items' quantity in 32 bits, which wraps; 0 where there is none.

    Addition modulo 2**32 doesn't mind the order, so each quantity is cut to 32 bits, sums are kept as wide decimals, which no number of rows
    overflows, and are cut in the end.
    """
    low = F.col("qty").cast("long").bitwiseAND(F.lit((1 << 32) - 1)).cast("decimal(18,0)")
    return slots.groupBy("container").agg(wrap32(F.coalesce(F.sum(F.when(wanted, low)) % (1 << 32), F.lit(0))).alias("qty"))


def container_params(slots: DataFrame, params: DataFrame, default: int) -> DataFrame:
    """By container: the sum of a parameter ``(item, value)`` over its slots, plain and times the quantity."""
    value = F.coalesce("value", F.lit(default)).cast("long")
    return slots.where("item >= 0").join(params, "item", "left").groupBy("container").agg(F.sum(value).alias("total"), F.sum(value * F.col("qty")).alias("weighted"))


def arg_max(rows: DataFrame, keys: list[str], value: str, order: str, groups: DataFrame | None = None, fallback: int | None = None) -> DataFrame:
    """The first row of the largest value: ordered pairs are maximised, so that partial aggregation keeps one each.

    Nulls of ``value`` never win over others. Groups of ``groups`` without rows get ``fallback`` for ``order``.
    """
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(order)).alias("__o"))).alias("__b"))
    best = best.select(*keys, F.col(f"__b.{value}").alias(value), (-F.col("__b.__o")).alias(order))
    if groups is None:
        return best
    return groups.select(*keys).join(best, keys, "left").withColumn(order, F.coalesce(order, F.lit(fallback)))


def percent_complete(rows: DataFrame, keys: list[str], ready: Column, groups: DataFrame | None = None) -> DataFrame:
    """Whole percents of rows that are ready; groups of ``groups`` without rows are complete."""
    if groups is not None:
        return groups.select(*keys).join(percent_complete(rows, keys, ready), keys, "left").withColumn("percent", F.coalesce("percent", F.lit(100)))
    return rows.groupBy(*keys).agg(F.call_function("div", F.count_if(ready) * 100, F.count("*")).cast("int").alias("percent"))


def bounding_box(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))


def rates(rows: DataFrame, ts: str, width: str, size: Column) -> DataFrame:
    """Rows and bytes in each tumbling window."""
    return rows.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes")).select(F.col("w.start").alias("start"), "n", "bytes")
