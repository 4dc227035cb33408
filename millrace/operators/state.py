"""Keyed state folded from ordered updates: latest value, resets, bit fields, recent ids and bounded logs."""

from __future__ import annotations

from collections import deque
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row; ``order`` is total, so partial aggregation keeps one row a key."""
    last = F.max(F.struct(*order, *[F.col(v).alias(f"__{v}") for v in values])).alias("__l")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"__l.__{v}").alias(v) for v in values])


def since_reset(rows: DataFrame, keys: list[str], order: str, reset: Column) -> DataFrame:
    """Rows after their key's last reset; all rows of keys without one."""
    last = rows.groupBy(*keys).agg(F.max(F.when(reset, F.col(order))).alias("__r"))
    return rows.join(last, keys).where(F.col("__r").isNull() | (F.col(order) > F.col("__r"))).drop("__r")


def upserts(rows: DataFrame, keys: list[str], order: list[str], values: list[str], deleted: Column) -> DataFrame:
    """Each key's last values, without the keys whose last update deletes them."""
    return latest(rows.withColumn("__gone", deleted), keys, order, [*values, "__gone"]).where("not __gone").drop("__gone")


def fold_fields(rows: DataFrame, keys: list[str], order: list[str], lo: str, hi: str, value: str) -> DataFrame:
    """32-bit variables after all writes of bit fields, in order, from 0: ``(keys, folded)``.

    Only a bit's last writer counts, so each of the 32 bits is a maximum over the writes that cover
    it: partial aggregation, no ordered list of a key's rows. Where one integer (below 2**62) orders the
    writes, the bit is packed below it, so that the aggregation is by hash. A value that doesn't fit writes 0.
    """
    width = F.col(hi) - F.col(lo) + 1
    fit = F.when((F.col(value) < 0) | (F.col(value) >= F.call_function("shiftleft", F.lit(1).cast("long"), width.cast("int"))), 0).otherwise(F.col(value)).cast("long")
    bit = lambda b: F.call_function("shiftright", fit, (F.lit(b) - F.col(lo)).cast("int")).bitwiseAND(F.lit(1))
    packed = len(order) == 1 and isinstance(rows.schema[order[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    write = (lambda b: F.col(order[0]).cast("long") * 2 + bit(b)) if packed else (lambda b: F.struct(*order, bit(b).alias("bit")))
    last = [F.max(F.when(F.lit(b).between(F.col(lo), F.col(hi)), write(b))).alias(f"b{b}") for b in range(32)]
    held = lambda b: F.col(f"b{b}").bitwiseAND(F.lit(1)) if packed else F.col(f"b{b}.bit")
    total = sum((F.coalesce(held(b), F.lit(0)) * (1 << b if b < 31 else -(1 << 31)) for b in range(32)), F.lit(0).cast("long"))
    return rows.groupBy(*keys).agg(*last).select(*keys, total.cast("int").alias("folded"))


def recent(rows: DataFrame, keys: list[str], order: list[str], size: int = 100) -> DataFrame:
    """Each key's last ``size`` rows with their place from 0, newest first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return rows.withColumn("place", place).where(F.col("place") <= size).withColumn("place", F.col("place") - 1)  # so that each task keeps a key's last rows only


def accept_ids(ids, seen: deque, held: set) -> list[bool]:
    """Which ids aren't among the last accepted ones; ``seen`` and ``held`` are the ring and its set."""
    out = []
    for i in ids:
        fresh = i not in held
        out.append(fresh)
        if fresh:
            if len(seen) == seen.maxlen:
                held.discard(seen[0])
            seen.append(i)
            held.add(i)
    return out


def dedupe_recent(rows: DataFrame, key: str, order: list[str], ident: str, size: int = 100) -> DataFrame:
    """Rows whose id isn't among the last ``size`` ids accepted for their key.

    The ring depends on what it accepted before, so a key's rows are one ordered run; they are
    streamed in sorted batches and only the ring is held.
    """

    def run(batches):
        state: dict = {}
        for batch in batches:
            keep, begin, ids = [], 0, batch.column(ident).to_pylist()
            for k, same in groupby(batch.column(key).to_pylist()):
                if k not in state:
                    state = {k: (deque(maxlen=size), set())}  # sorted by key: one ring at a time
                end = begin + sum(1 for _ in same)
                keep += accept_ids(ids[begin:end], *state[k])
                begin = end
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, rows.schema)


def list_changes(rows: DataFrame, tick: str, ident: str, values: list[str]) -> DataFrame:
    """What each tick's list adds, updates and removes against the tick before: ``(tick, ident, change)``."""
    now = rows.select(F.col(tick).alias("t"), F.col(ident).alias("i"), F.struct(*values).alias("v"))
    before = now.select((F.col("t") + 1).alias("t"), "i", F.col("v").alias("w"))
    ticks = now.agg(F.max("t").alias("last"))
    joined = now.join(before, ["t", "i"], "full").join(F.broadcast(ticks), F.col("t") <= F.col("last")).drop("last")
    change = F.when(F.col("w").isNull(), "add").when(F.col("v").isNull(), "remove").when(F.col("v") == F.col("w"), "same").otherwise("update")
    return joined.select(F.col("t").alias(tick), F.col("i").alias(ident), change.alias("change"))


def expand_runs(rows: DataFrame, begin: str, count: str, slots: int | None = None) -> DataFrame:
    """Slots of runs ``(begin, count)``: one row each, none for empty runs. A run that goes beyond ``slots`` is an error."""
    if slots is not None:
        over = F.col(begin) + F.col(count) > slots
        rows = rows.withColumn(count, F.when(over, F.raise_error(F.lit("a run skips more slots than are left"))).otherwise(F.col(count)))
    return rows.where(F.col(count) > 0).withColumn("slot", F.explode(F.sequence(F.col(begin), F.col(begin) + F.col(count) - 1)))


def skip_passes(slots: DataFrame, updates: DataFrame) -> DataFrame:
    """What becomes of each slot of ``slots (tick, slot, in_view, was_active)`` under its tick's updates.

    Slots are passed four times: those in view that weren't active, those in view that were, then of
    those out of view the active and the others. ``updates (tick, pass, k, skip, value)`` has each pass's
    entries in order: either a value for the next slot, or a number of slots to skip after the next.
    Returns ``(tick, slot, pass, value)``, value null where the slot is skipped. A pass whose entries
    reach beyond its slots is an error, as are entries that don't reach all.
    """
    number = F.when(F.col("in_view"), F.when(F.col("was_active"), 1).otherwise(0)).otherwise(F.when(F.col("was_active"), 2).otherwise(3))
    order = Window.partitionBy("tick", "pass").orderBy("slot")
    placed = slots.withColumn("pass", number).withColumn("at", F.row_number().over(order) - 1)
    # entry k begins where the slots of those before end
    width = F.coalesce("skip", F.lit(0)) + 1
    after = F.sum(width).over(Window.partitionBy("tick", "pass").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = updates.withColumn("begin", after - width).withColumn("n", width)
    reach = runs.groupBy("tick", "pass").agg(F.sum("n").alias("reach"))
    sizes = placed.groupBy("tick", "pass").agg(F.count("*").alias("size"))
    covered = expand_runs(runs.select("tick", "pass", "begin", "n", "value"), "begin", "n").select("tick", "pass", F.col("slot").alias("at"), F.when(F.col("slot") == F.col("begin"), F.col("value")).alias("value"))
    checked = sizes.join(reach, ["tick", "pass"], "full").withColumn("good", F.when(F.col("size").eqNullSafe(F.col("reach")), True).otherwise(F.raise_error(F.format_string("pass %d of tick %d: its entries don't fill it", F.col("pass"), F.col("tick")))))
    return placed.join(covered, ["tick", "pass", "at"], "left").join(checked.where("good").select("tick", "pass"), ["tick", "pass"]).select("tick", "slot", "pass", "value")


#: Steps of the coarse position by direction 0 to 7, rows from south to north.
STEPS = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def coarse_regions(moves: DataFrame, slot: str, order: str) -> DataFrame:
    """Each slot's plane and coarse region after its moves ``(kind, plane, dx, dy, direction, x, y)``; places where it comes into view.

    Out of view a slot's position is a plane modulo 4 and a region of 64 x 64 modulo 256. Kind 1 moves
    the plane, kind 2 the plane and one step in a direction, kind 3 all by differences; kind 0 takes the slot
    into view at (x, y) within its region. Differences add up, so the state is a running sum.
    """
    step = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in STEPS]), F.col("direction") + 1)
    moved = lambda c, i: F.when(F.col("kind") == 2, step(i)).when(F.col("kind") == 3, F.col(c)).otherwise(0)
    past = Window.partitionBy(slot).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c, m: F.pmod(F.sum(c).over(past), F.lit(m)).cast("int")
    out = moves.withColumn("region_plane", total(F.when(F.col("kind") == 0, 0).otherwise(F.col("plane")), 4)).withColumn("region_x", total(moved("dx", 0), 256)).withColumn("region_y", total(moved("dy", 1), 256))
    seen = F.col("kind") == 0
    return out.withColumn("tile_x", F.when(seen, F.col("x") + F.col("region_x") * 64).cast("int")).withColumn("tile_y", F.when(seen, F.col("y") + F.col("region_y") * 64).cast("int"))


def two_strikes(requests: DataFrame, key: str, opened: str, closed: str, seconds: int, until: Column) -> DataFrame:
    """When each request of ``requests (key, opened, closed)`` is dropped, by sweeps every so many seconds up to a time.

    The first sweep after its opening that finds a request open marks it, the next drops it: ``(key,
    dropped)``, null where the request closes before that sweep or the sweeps end.
    """
    second = F.timestamp_seconds((F.floor(F.unix_seconds(opened) / seconds) + 2) * seconds)
    gone = (F.col(closed).isNull() | (F.col(closed) > second)) & (second <= until)
    return requests.select(key, F.when(gone, second).alias("dropped"))


def stalls(rows: DataFrame, keys: list[str], ts: str, order: list[str], answer: Column, most_step: int, limit: int) -> DataFrame:
    """Rows at which a key has waited over ``limit`` ms since its last answer; a gap between rows counts ``most_step`` ms at most."""
    past = Window.partitionBy(*keys).orderBy(*order)
    gap = F.unix_millis(ts) - F.lag(F.unix_millis(ts)).over(past)
    out = rows.withColumn("__gap", F.least(F.coalesce(gap, F.lit(0)), F.lit(most_step))).withColumn("__answer", answer).withColumn("__span", F.sum(F.col("__answer").cast("int")).over(past))
    # the row with an answer begins a span, its own gap aside
    waited = F.sum(F.when(F.col("__answer"), 0).otherwise(F.col("__gap"))).over(Window.partitionBy(*keys, "__span").orderBy(*order))
    return out.withColumn("waited", waited).where(F.col("waited") > limit).drop("__gap", "__answer", "__span")


def first_members(rows: DataFrame, keys: list[str], name: str, order: list[str], values: list[str], size: int = 100) -> DataFrame:
    """Each list's first ``size`` names with their last values: a full list takes no new name, but still updates those it has."""
    first = rows.groupBy(*keys, name).agg(F.min(F.struct(*order)).alias("__first"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__first"))).where(F.col("place") <= size)
    return placed.select(*keys, name, (F.col("place") - 1).alias("place")).join(latest(rows, [*keys, name], order, values), [*keys, name])


def splice(front: DataFrame, back: DataFrame, place: str) -> DataFrame:
    """All rows of one list moved behind those of another, each in its order; places count from 0."""
    ahead = front.agg(F.count("*").alias("__n"))  # one row
    return front.unionByName(back.join(F.broadcast(ahead)).withColumn(place, F.col(place) + F.col("__n")).drop("__n"))


def without_ignored(messages: DataFrame, sender: str, privilege: str, ignored: DataFrame) -> DataFrame:
    """Messages but those of ignored senders whose privilege is at most 1."""
    names = ignored.select(F.col(sender).alias("__sender")).distinct()
    return messages.join(names, (F.col(sender) == F.col("__sender")) & (F.col(privilege) <= 1), "left_anti")


def offset_places(added: DataFrame, observers: DataFrame, key: str) -> DataFrame:
    """Places ``(x, y)`` of rows ``(key, dx, dy)`` whose offsets from their observer's place are signed numbers of 5 bits."""
    signed = lambda c: F.when(F.col(c) > 15, F.col(c) - 32).otherwise(F.col(c))
    joined = added.join(observers, key)
    return joined.withColumn("x", F.col("x") + signed("dx")).withColumn("y", F.col("y") + signed("dy")).drop("dx", "dy")


def populations(worlds: DataFrame, deltas: DataFrame, order: list[str]) -> DataFrame:
    """``worlds (id, population, ...)`` with the last of their ``deltas (id, population)``; 65535 is unknown (-1), other ids are ignored."""
    last = latest(deltas, ["id"], order, ["population"]).select("id", F.when(F.col("population") == 65535, -1).otherwise(F.col("population")).alias("__now"))
    return worlds.join(last, "id", "left").withColumn("population", F.coalesce("__now", "population")).drop("__now")
