"""Ordered lists that change from tick to tick by codes, without walking through the ticks.

What is in a list keeps its order of coming until it goes, so an entry's place is its rank by arrival among those that
are there; arrivals are carried along each entry's ticks, and ranks are taken within each tick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Codes of a tick's entries: unchanged, changed otherwise, one step, two steps, gone; and one that comes behind all others.
SAME, CHANGED, STEPPED, RAN, GONE, ADDED = -1, 0, 1, 2, 3, 4
_NAMES = {SAME: "same", CHANGED: "changed", STEPPED: "stepped", RAN: "ran", GONE: "gone", ADDED: "added"}


def fold_lists(rows: DataFrame, keys: list[str], tick: str, ident: str, k: str, code: str, dx: str, dy: str) -> DataFrame:
    """What becomes of lists under ``rows (keys, tick, ident, k, code, dx, dy)``: ``(keys, tick, ident, what, place, x, y)``.

    Ticks are whole numbers. A tick first sends a code for entries of the list, from its head on; those behind the last one sent are
    ``unsent`` and go, as do those with GONE. Then ADDED entries come behind the rest, in order of ``k``; an entry may go, unsent too, and come again in one tick. A
    list without rows at a tick sends nothing, so all of it goes, up to the last tick of any list. ``place`` counts from 0, and is null for what goes; x
    and y are sums of dx and dy since the entry came, its first included.

    Errors: a code for what isn't in the list (a list never grows but by ADDED), ADDED for what is, an entry that isn't
    sent before one that is, and codes out of range. Nulls in dx and dy are 0; a null ident is an entry like any other.
    """
    over = [F.col(c) for c in keys]
    added, gone = F.col("__code") == ADDED, F.col("__code") == GONE
    base = rows.select(*over, F.col(tick).cast("long").alias("__t"), F.col(ident), F.col(k).alias("__k"), F.col(code).cast("int").alias("__code"), F.coalesce(F.col(dx), F.lit(0)).alias("__dx"), F.coalesce(F.col(dy), F.lit(0)).alias("__dy"))
    entry = Window.partitionBy(*keys, ident).orderBy("__t", added)
    before, after = F.lag("__t").over(entry), F.lead("__t").over(entry)
    held = base.withColumns({
        "__was": F.coalesce((before == F.col("__t") - 1) & (F.lag("__code").over(entry) != GONE), F.lit(False)),
        "__stays": F.coalesce((before == F.col("__t")) & (F.lag("__code").over(entry) != GONE), F.lit(False)),
        "__next": F.coalesce(after == F.col("__t") + 1, F.lit(False)) & (F.lead("__code").over(entry) != ADDED),
        "__born": F.last(F.when(added, F.struct(F.col("__t"), F.col("__k"))), True).over(entry),
        "__life": F.sum(added.cast("int")).over(entry),
    })
    wrong = (
        F.when(~F.coalesce(F.col("__code").between(SAME, ADDED), F.lit(False)), "a code out of range")
        .when(added & F.col("__stays"), "an entry comes that is in the list")
        .when(~added & ~F.col("__was"), "a code for an entry that isn't in the list")
    )
    fault = lambda what: F.raise_error(F.concat(what, F.lit(" at tick "), F.col("__t").cast("string")))
    held = held.withColumn("__code", F.when(wrong.isNotNull(), fault(wrong).cast("int")).otherwise(F.col("__code")))
    since = Window.partitionBy(*keys, ident, "__life").orderBy("__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumns({"x": F.sum("__dx").over(since), "y": F.sum("__dy").over(since)})
    there = Window.partitionBy(*keys, "__t").orderBy(gone, "__born")
    placed = held.withColumn("place", F.when(~gone, F.row_number().over(there) - 1))
    # behind the first that isn't sent at the next tick none is
    whole = Window.partitionBy(*keys, "__t")
    last_sent, first_unsent = F.max(F.when(F.col("__next"), F.col("place"))).over(whole), F.min(F.when(~F.col("__next"), F.col("place"))).over(whole)
    ends = base.agg(F.max("__t").alias("__end"))  # one row
    placed = placed.withColumn("__gap", F.coalesce(last_sent > first_unsent, F.lit(False))).join(F.broadcast(ends))
    goes = ~gone & ~F.col("__next") & (F.col("__t") < F.col("__end"))
    goes = F.when(goes & F.col("__gap"), fault(F.lit("an entry isn't sent before one that is, behind the list")).cast("boolean")).otherwise(goes)
    what = F.element_at(F.create_map(*[F.lit(x) for n in _NAMES.items() for x in n]), F.col("__code"))
    now = F.struct(F.col("__t").alias("t"), what.alias("what"), F.col("place").cast("int").alias("place"))
    then = F.struct((F.col("__t") + 1).alias("t"), F.lit("unsent").alias("what"), F.lit(None).cast("int").alias("place"))
    told = placed.withColumn("__o", F.explode(F.when(goes, F.array(now, then)).otherwise(F.array(now))))
    return told.select(*keys, F.col("__o.t").alias(tick), ident, F.col("__o.what").alias("what"), F.col("__o.place").alias("place"), "x", "y")
