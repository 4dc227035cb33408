"""Framed messages, change journals, observer-relative upserts and view transitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state
from ..sources import load
from ..sources.frames import U8, U16, frame, split_frames
from .registry import query

LENGTHS = {1: U8, 2: U16, 3: 4}


@query("SELECT conv_id AS seq, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS place, (CASE WHEN strlen(text) < 256 AND turn % 2 = 0 THEN 1 ELSE 2 END)::int AS kind, text AS said FROM conversations")
def framed_messages(spark, sf_dir):
    """Each conversation's turns framed into one block, and split again."""

    def pack(batches):
        for batch in batches:
            raw = [b"".join(frame(1 if len(b := t["text"].encode()) < 256 and t["turn"] % 2 == 0 else 2, b, LENGTHS) for t in turns) for turns in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(raw, pa.binary())], names=["seq", "raw"])

    c = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return split_frames(c.mapInArrow(pack, "seq long, raw binary"), LENGTHS).select("seq", "place", "kind", F.col("payload").cast("string").alias("said"))


@query("SELECT user_id, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 32")
def change_journal(spark, sf_dir):
    """A ring of 32: the last changes."""
    return load(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(32).select("user_id", "event_id")


@query("""
WITH l AS (SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)
SELECT a.user_id, a.event_type, (a.event_id - o.event_id)::bigint AS ahead FROM l a JOIN l o ON o.user_id = a.user_id AND o.event_type = 'view' WHERE a.event_type <> 'view'""")
def observer_offsets(spark, sf_dir):
    """Latest rows relative to their observer's."""
    last = state.latest(load(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id"])
    seen = last.where("event_type = 'view'").select("user_id", F.col("event_id").alias("at"))
    return last.where("event_type <> 'view'").join(seen, "user_id").select("user_id", "event_type", (F.col("event_id") - F.col("at")).alias("ahead"))


@query("""
WITH o AS (SELECT user_id, arg_max(event_id, (ts, event_id)) % 1000 AS x, arg_max(event_id, (ts, event_id)) % 700 AS y FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT event_id, (x + CASE WHEN event_id % 32 > 15 THEN event_id % 32 - 32 ELSE event_id % 32 END)::bigint AS x, (y + CASE WHEN event_id // 32 % 32 > 15 THEN event_id // 32 % 32 - 32 ELSE event_id // 32 % 32 END)::bigint AS y
FROM events JOIN o USING (user_id) WHERE event_type = 'signup' AND event_id % 40000 <> 32767""")
def observer_additions(spark, sf_dir):
    """Rows added at a signed 5-bit offset from their observer's last place; the largest 15-bit id ends a list."""
    e = load(spark, sf_dir, "events")
    at = state.latest(e.where("event_type = 'view'"), ["user_id"], ["ts", "event_id"], ["event_id"]).select("user_id", (F.col("event_id") % 1000).alias("x"), (F.col("event_id") % 700).alias("y"))
    i = F.col("event_id")
    added = e.where((F.col("event_type") == "signup") & (i % 40_000 != 32_767)).select("user_id", "event_id", (i % 32).alias("dx"), (F.floor(i / 32) % 32).alias("dy"))
    return state.offset_places(added, at, "user_id").select("event_id", "x", "y")


@query("""
SELECT user_id, event_id, CASE WHEN now THEN 'in' ELSE 'out' END AS moved FROM (
  SELECT *, lag(now, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, value > 50 AS now FROM events)) WHERE now <> before""")
def view_transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").withColumn("now", F.col("value") > 50)
    e = e.withColumn("before", F.lag("now", 1, False).over(w)).where(F.col("now") != F.col("before"))
    return e.select("user_id", "event_id", F.when(F.col("now"), "in").otherwise("out").alias("moved"))
