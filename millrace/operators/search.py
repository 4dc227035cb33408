"""Text search that fails, rather than truncates, over its cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sorting import place

#: Results of up to so many rows are sorted in one task.
TOGETHER = 10_000


def matches(rows: DataFrame, name: str, query: str, also: Column) -> DataFrame:
    """Rows whose name holds the query without case; an empty query matches all."""
    return rows.where(also & F.lower(name).contains(query.lower()))


def search(rows: DataFrame, name: str, query: str, also: Column, key: str, cap: int) -> DataFrame:
    """Matches in order of name with their place from 0; none if there are more than ``cap``.

    Of a cap up to ``TOGETHER`` only cap + 1 rows are ever brought together: more mean no result. Larger results
    are ranked in ranges.
    """
    found = matches(rows, name, query, also)
    if cap > TOGETHER:
        few = found.limit(0) if found.limit(cap + 1).count() > cap else found
        return place(few, name, key).withColumn("place", (F.col("place") - 1).cast("int"))
    few = found.orderBy(name, key).limit(cap + 1)
    total = F.count("*").over(Window.partitionBy())
    at = (F.row_number().over(Window.orderBy(name, key)) - 1).cast("int")
    return few.withColumn("__n", total).withColumn("place", at).where(F.col("__n") <= cap).drop("__n")


def search_size(rows: DataFrame, name: str, query: str, also: Column, cap: int) -> DataFrame:
    """The number of matches, -1 over the cap."""
    n = F.count("*")
    return matches(rows, name, query, also).agg(F.when(n > cap, -1).otherwise(n).cast("int").alias("found"))
