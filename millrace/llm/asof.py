"""Tolerant as-of join: rows are cogrouped by key and time chunk, each chunk with its halo of earlier orders.

Chunks are as wide as the tolerance. Where a key has too many rows in one, the chunk is split into
narrower ones, again and again; what still meets in a narrowest chunk is dealt over blocks, each with the
chunk's orders. A chunk's halo is the one order that rows before its first order can match: the
key's latest before the chunk. Chunks are packed into slots; in each, ``merge_asof`` looks
backward within the tolerance. Nothing that grows with the input is broadcast or gathered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shipping import ship
from .store import cut

HOUR = 3_600_000_000
#: Widths below the first, which is the tolerance, in microseconds: a day, an hour, a minute, a second.
NARROWER = (24 * HOUR, HOUR, 60_000_000, 1_000_000)
#: Rows of a chunk that aren't split further, and slots for each shuffle partition.
CHUNK_ROWS, SLOTS_EACH = 4_096, 8
#: Bits of the map that tells rows of chunks to split from most others; its size is fixed, whatever the input.
BITS = 1 << 16


def micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken as UTC, whatever the session's zone."""
    c = F.col(name)
    if isinstance(rows.schema[name].dataType, T.TimestampNTZType):
        day = F.unix_date(c.cast("date")).cast("long") * (24 * HOUR)
        second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return day + F.hour(c).cast("long") * HOUR + F.minute(c).cast("long") * 60_000_000 + second
    return F.unix_micros(c)


def collapse_ties(orders: DataFrame, by: str, at: str, lower: list[str], higher: list[str], values: list[str]) -> DataFrame:
    """One row for each key and time: ``(by, at, *values, n_tied)``, those of the best order, and how many there are.

    The best has the smallest ``lower`` columns in turn, then the largest ``higher`` ones; a null
    loses against any value. ``lower`` and ``higher`` are numbers. Orders that tie in all go by the
    smallest ``values``. Orders with null key or time are none.
    """
    rank = [x for c in lower for x in (F.col(c).isNull(), F.col(c))] + [x for c in higher for x in (F.col(c).isNull(), -F.col(c))]
    named = [c.alias(f"o{k}") for k, c in enumerate(rank)] + [x for c in values for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(f"v_{c}"))]
    kept = orders.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    best = kept.groupBy(by, at).agg(F.min(F.struct(*named)).alias("best"), F.count("*").alias("n_tied"))
    return best.select(by, at, *[F.col(f"best.v_{c}").alias(c) for c in values], "n_tied")


def _bits(hot: DataFrame) -> Column:
    """Whether a row ``(_by, _index)`` may be among ``hot``, by a bitmap of fixed size: no hash of ``hot`` is told as absent."""
    place = F.pmod(F.xxhash64("_by", "_index"), F.lit(BITS))
    some = hot.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    words = np.zeros(BITS // 64, "<i8")
    for k, b in some.collect():  # 4,096 bytes for 32,768 bits, which count from 1
        held = np.frombuffer(bytes(b), "<i8")
        at = (k - 1) * (32_768 // 64)
        words[at : at + len(held)] = held[: len(words) - at]
    held = F.element_at(F.array(*[F.lit(int(w)) for w in words]), F.floor(place / 64).cast("int") + 1)
    return F.call_function("shiftrightunsigned", held, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def _matcher(by: str, at: str, tolerance: int, values: list[str]):
    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        n = left.num_rows
        keys = pd.DataFrame({k: np.concatenate([left.column(k).to_numpy(), right.column(k).to_numpy()]) for k in (by, "_start", "_block")})
        code = keys.groupby(list(keys.columns), sort=False).ngroup().to_numpy()  # a chunk's number in the slot
        rows = pd.DataFrame({"at": left.column(at).to_numpy(), "chunk": code[:n], "row": np.arange(n)}).sort_values("at", kind="stable")
        orders = pd.DataFrame({"at": right.column(at).to_numpy(), "chunk": code[n:], "order": np.arange(right.num_rows)}).sort_values("at", kind="stable")
        found = pd.merge_asof(rows, orders, on="at", by="chunk", direction="backward", tolerance=tolerance)
        out = left.drop_columns(["_slot", "_start", "_block"]).take(pa.array(found["row"].to_numpy()))
        at_order = pa.array(found["order"].to_numpy("float64"), from_pandas=True).cast(pa.int64())
        for c in values:
            out = out.append_column(c, right.column(c).take(at_order))
        return out.append_column("matched_at", right.column(at).take(at_order))

    return match


def asof_join(rows: DataFrame, orders: DataFrame, by: str, at: str, values: list[str], tolerance: int, chunk_rows: int = CHUNK_ROWS, narrower: tuple[int, ...] = NARROWER, slots: int | None = None) -> DataFrame:
    """Each row of ``rows (by, at, ...)`` with its key's latest order at or before it, at most ``tolerance`` microseconds earlier.

    ``orders (by, at, *values)`` has one row for each key and time (``collapse_ties``); ``by`` and
    ``at`` are long. Returns the columns of ``rows``, the order's ``values`` and ``matched_at``, null
    where nothing matches. A null key or time never matches; such rows and repeated ones are
    returned like any other. Empty tables are fine. Names that begin with ``_`` are the operator's.
    """
    if tolerance <= 0:
        raise ValueError("the tolerance must be positive")
    spark = rows.sparkSession
    ship(spark)
    widths = [tolerance]
    for w in narrower:
        if w < widths[-1] and widths[-1] % w == 0:  # narrower chunks never lie across a border of wider ones
            widths.append(w)
    whole = F.col(by).isNotNull() & F.col(at).isNotNull()
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, orders.schema[c].dataType) for c in values], T.StructField("matched_at", T.LongType())])
    columns = rows.columns
    rows = cut(rows.withColumn("_salt", (F.rand() * (1 << 31)).cast("int")), "asof")  # drawn once, so that repeated rows part
    alone = rows.where(~whole).select(*columns, *[F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in values], F.lit(None).cast("long").alias("matched_at"))
    active = [rows.where(whole), cut(orders.where(whole).select(by, at, *values), "asof")]
    order = F.struct(at, *values)
    done: list[list[DataFrame]] = [[], []]
    cells: list[DataFrame] = []
    total = 0
    for level, width in enumerate(widths):
        # each chunk of this width: its rows to match, all rows, the latest order
        at_level = [r.withColumn("_by", F.col(by)).withColumn("_index", F.floor(F.col(at) / width)) for r in active]
        lefts = at_level[0].groupBy("_by", "_index").agg(F.count("*").alias("n"), F.count("*").alias("n_left"))
        rights = at_level[1].groupBy("_by", "_index").agg(F.count("*").alias("n"), F.max(order).alias("_last"))
        told = lefts.withColumn("_last", F.lit(None).cast(rights.schema["_last"].dataType)).unionByName(rights.withColumn("n_left", F.lit(0).cast("long")))
        told = cut(told.groupBy("_by", "_index").agg(F.sum("n").alias("n"), F.sum("n_left").alias("n_left"), F.first("_last", True).alias("_last")), "asof")
        last = level + 1 == len(widths)
        hot = F.col("n_left" if last else "n") > chunk_rows
        blocks = F.ceil(F.col("n_left") / chunk_rows).cast("int") if last else F.least(F.col("n_left"), F.lit(1)).cast("int")
        cells.append((told if last else told.where(~hot)).select(F.col("_by").alias(by), (F.col("_index") * width).alias("_start"), blocks.alias("_blocks"), "_last"))
        total = total or (told.agg(F.sum("n")).first()[0] or 0)
        crowded = told.where(hot).select(F.col("_by").alias("_hot_by"), F.col("_index").alias("_hot_index"), (blocks if last else F.lit(1)).alias("_hot"))
        more = not crowded.isEmpty()
        maybe = _bits(crowded.select(F.col("_hot_by").alias("_by"), F.col("_hot_index").alias("_index"))) if more else F.lit(False)
        for k, r in enumerate(at_level):
            plain = [*r.columns[:-2], (F.col("_index") * width).alias("_start")]
            done[k].append(r.where(~maybe).select(*plain, F.lit(1).alias("_blocks")))
            if more:
                joined = r.where(maybe).join(crowded.hint("merge"), (F.col("_by") == F.col("_hot_by")) & (F.col("_index") == F.col("_hot_index")), "left")
                joined = cut(joined.select(*plain, F.coalesce("_hot", F.lit(0)).alias("_blocks")), "asof")
                done[k].append(joined.where(F.lit(last) | (F.col("_blocks") == 0)).withColumn("_blocks", F.greatest("_blocks", F.lit(1))))
                active[k] = joined.where("_blocks > 0").drop("_start", "_blocks")
        if not more:
            break
    left, right = (reduce(DataFrame.unionByName, parts) for parts in done)
    chunks = reduce(DataFrame.unionByName, cells).withColumn("_wide", F.floor(F.col("_start") / tolerance))
    # each chunk's halo: the key's latest order before it, in the same wide chunk or in the one before
    past = Window.partitionBy(by, "_wide").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    seen = chunks.withColumn("_own", F.last("_last", True).over(past)).where("_blocks > 0").drop("_last")
    ends = chunks.where("_last IS NOT NULL").groupBy(by, (F.col("_wide") + 1).alias("_wide")).agg(F.max("_last").alias("_before"))
    halo = seen.join(ends.hint("merge"), [by, "_wide"], "left").select(by, "_start", "_blocks", F.coalesce("_own", "_before").alias("_o")).where("_o IS NOT NULL")
    halo = halo.select(by, *[F.col(f"_o.`{c}`").alias(c) for c in (at, *values)], "_start", "_blocks")
    # rows of a narrowest chunk with too many are dealt over blocks, and its orders go to each
    n_slots = slots or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * CHUNK_ROWS))) * SLOTS_EACH
    slot = F.pmod(F.xxhash64(by, "_start", "_block"), F.lit(n_slots)).alias("_slot")
    block = F.when(F.col("_blocks") > 1, F.col("_salt") % F.col("_blocks")).otherwise(0)
    left = left.withColumn("_block", block).select(*columns, "_start", "_block", slot)
    right = right.unionByName(halo).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(by, at, *values, "_start", "_block", slot)
    joined = left.groupBy("_slot").cogroup(right.groupBy("_slot")).applyInArrow(_matcher(by, at, tolerance, values), schema)
    return joined.unionByName(alone)
