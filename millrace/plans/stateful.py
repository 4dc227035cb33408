"""Keyed state over the events, changes between lists, grids and images."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import graph, raster, state
from ..sources import load, load_stream
from ..sources.archive import container, pack_group, split_groups
from ..sources.sequence import batch_size, read_sequence, write_sequence
from ..streaming import state as streaming
from .registry import query

#: Rows of a batch that may all be of one key and be held by one worker.
_HELD = 500_000


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_event(spark, sf_dir):
    return state.latest(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("""
SELECT user_id, count(*) AS n FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS r FROM events WHERE event_type = 'error' GROUP BY 1) x USING (user_id)
WHERE r IS NULL OR event_id > r GROUP BY 1""")
def events_since_reset(spark, sf_dir):
    return state.since_reset(load(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "error").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'click'""")
def member_list(spark, sf_dir):
    return state.upserts(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value"], F.col("event_type") == "click")


@query("""
WITH e AS (SELECT user_id, event_id, event_id % 7 * 4 AS lo, event_id % 7 * 4 + event_id % 5 AS hi, event_id % 41 - 2 AS v FROM events),
w AS (SELECT *, CASE WHEN v < 0 OR v >= (1::bigint << (hi - lo + 1)) THEN 0 ELSE v END AS fit FROM e),
b AS (SELECT user_id, bit, arg_max((fit >> (bit - lo)) & 1, event_id) AS is_set FROM w, (SELECT unnest(range(32)) AS bit) WHERE bit BETWEEN lo AND hi GROUP BY 1, 2)
SELECT user_id, ((sum(is_set::bigint * (1::bigint << bit)) + 2147483648) % 4294967296 - 2147483648)::int AS folded FROM b GROUP BY 1""")
def folded_fields(spark, sf_dir):
    i = F.col("event_id")
    e = load(spark, sf_dir, "events").select("user_id", "event_id", (i % 7 * 4).cast("int").alias("lo"), (i % 7 * 4 + i % 5).cast("int").alias("hi"), (i % 41 - 2).alias("v"))
    return state.fold_fields(e, ["user_id"], ["event_id"], "lo", "hi", "v")


@query("""
SELECT event_type, event_id, place FROM (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1)::int AS place FROM events) WHERE place < 100""")
def message_log(spark, sf_dir):
    return state.recent(load(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id", "place")


#: The ring of the last hundred accepted ids, folded over each key's rows in order.
_RING = """
WITH l AS (SELECT event_type, list({'e': event_id, 'u': user_id, 'ring': []::BIGINT[], 'kept': []::BIGINT[]} ORDER BY ts, event_id) AS held FROM events GROUP BY 1),
f AS (SELECT event_type, list_reduce([{'e': 0::BIGINT, 'u': 0::BIGINT, 'ring': []::BIGINT[], 'kept': []::BIGINT[]}] || held,
  lambda s, r: CASE WHEN list_contains(s.ring, r.u) THEN s ELSE {'e': r.e, 'u': r.u, 'ring': list_slice(s.ring || [r.u], -100, -1), 'kept': s.kept || [r.e]} END) AS s FROM l),
k AS (SELECT event_type, unnest(s.kept) AS event_id FROM f)
SELECT event_type, ts, event_id, user_id FROM events SEMI JOIN k USING (event_type, event_id)"""


@query(_RING)
def dedupe_last_100(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    return state.dedupe_recent(e, "event_type", ["ts", "event_id"], "user_id", 100)


@query("""
WITH t AS (SELECT DISTINCT event_id // 200 AS tick, user_id FROM events), m AS (SELECT tick, user_id, user_id % 3 + tick % 2 * (user_id % 2) AS v FROM t)
SELECT coalesce(a.tick, b.tick + 1) AS tick, coalesce(a.user_id, b.user_id) AS user_id,
  CASE WHEN b.user_id IS NULL THEN 'add' WHEN a.user_id IS NULL THEN 'remove' WHEN a.v = b.v THEN 'same' ELSE 'update' END AS change
FROM m a FULL JOIN m b ON a.tick = b.tick + 1 AND a.user_id = b.user_id WHERE coalesce(a.tick, b.tick + 1) <= (SELECT max(tick) FROM m)""")
def list_changes(spark, sf_dir):
    m = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 200).alias("tick"), "user_id").distinct()
    m = m.withColumn("v", F.col("user_id") % 3 + F.col("tick") % 2 * (F.col("user_id") % 2))
    return state.list_changes(m, "tick", "user_id", ["v"])


@query("SELECT o_orderkey, unnest(range(o_orderkey % 10, o_orderkey % 10 + o_custkey % 4)) AS slot FROM orders")
def skipped_slots(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("begin"), (F.col("o_custkey") % 4).alias("n"))
    return state.expand_runs(o, "begin", "n").select("o_orderkey", "slot")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def stream_rates(spark, sf_dir):
    return streaming.drain(streaming.windowed_rates(load_stream(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes"), "complete")


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1
HAVING time_bucket(INTERVAL '1 hour', min(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '3 hours'""")
def stream_closed_rates(spark, sf_dir):
    """Windows that the watermark has passed, three hours behind the latest event."""
    return streaming.drain(streaming.windowed_rates(load_stream(spark, sf_dir, "events"), "ts", "1 hour", "3 hours"), "append")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_latest(spark, sf_dir):
    return streaming.drain(streaming.latest_values(load_stream(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"]), "complete")


@query(_RING)
def stream_dedupe(spark, sf_dir):
    """A worker holds a type's rows of a batch, so batches have ``_HELD`` rows at most."""
    e = load(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id")
    order = [F.col(c).asc_nulls_last() for c in ("ts", "event_id")]
    stream = read_sequence(spark, write_sequence(e, order, batch_size(e.count(), 2_500, _HELD, 2)), e.schema)
    return streaming.drain(streaming.dedupe_recent(stream, "event_type", ["ts", "event_id"], "user_id"), "append", partitions=4)


@query("SELECT (p_partkey // 5)::int AS grp, (row_number() OVER (PARTITION BY p_partkey // 5 ORDER BY p_partkey) - 1)::int AS file, p_name AS name FROM part")
def packed_groups(spark, sf_dir):
    """Names packed five to a group, in deflated containers of two chunks, and split again."""
    p = load(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 5).cast("int").alias("grp"), F.col("p_partkey").alias("k"), "p_name")

    def pack(batches):
        for batch in batches:
            raw = [container(pack_group([n.encode() for n in names], 2), 2) for names in batch.column("names").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array([len(n) for n in batch.column("names").to_pylist()], pa.int32()), pa.array(raw, pa.binary())], names=["grp", "count", "raw"])

    listed = p.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", "p_name"))).alias("f")).select("grp", F.transform("f", lambda f: f["p_name"]).alias("names"))
    groups = listed.mapInArrow(pack, "grp int, count int, raw binary")
    return split_groups(groups).select("grp", "file", F.col("data").cast("string").alias("name"))


@query("""
WITH RECURSIVE c AS (SELECT x::int AS x, y::int AS y FROM range(24) a(x), range(24) b(y) WHERE (x * 7 + y * 13) % 5 <> 0 OR (x = 0 AND y = 0)),
w AS (SELECT 0 AS x, 0 AS y, 0 AS cost UNION
  SELECT n.x, n.y, w.cost + 1 FROM w JOIN c n ON abs(n.x - w.x) <= 1 AND abs(n.y - w.y) <= 1 AND (n.x <> w.x OR n.y <> w.y)
  WHERE w.cost < 12 AND (n.x = w.x OR n.y = w.y OR (EXISTS (SELECT 1 FROM c p WHERE p.x = n.x AND p.y = w.y) AND EXISTS (SELECT 1 FROM c q WHERE q.x = w.x AND q.y = n.y))))
SELECT x, y, min(cost)::int AS cost FROM w GROUP BY 1, 2""")
def grid_paths(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return graph.grid_costs(spark, raster.canvas(spark, 24, 24).where(((x * 7 + y * 13) % 5 != 0) | ((x == 0) & (y == 0))), (0, 0), 12)


_IMG = "SELECT (i % 32)::int AS x, (i // 32)::int AS y, ((i % 32 * 37 + i // 32 * 91) * 53 % 5000)::bigint AS v FROM range(1024) t(i)"


def _image(spark):
    return raster.canvas(spark, 32, 32).withColumn("v", ((F.col("x") * 37 + F.col("y") * 91) * 53 % 5000).cast("long"))


@query(f"""
SELECT x, y, greatest(500, least(v, 3000))::bigint AS clamped, 4096 - v AS inverted, (CASE WHEN v BETWEEN 1000 AND 2000 THEN 4096 ELSE 0 END)::bigint AS bands, floor(v * 1500 / 4096)::bigint + 300 AS ranged,
  (x * 4096 // 32)::bigint AS gx, (y * 4096 // 32)::bigint AS gy, greatest(0, least(255, v // 16))::int AS shown,
  (CASE WHEN v <= 0 THEN 4096 WHEN v < 2048 THEN 4096 + (v * (1000 - 4096)) // 2048 WHEN v < 4096 THEN 1000 + ((v - 2048) * 3000) // 2048 ELSE 4000 END)::bigint AS curved FROM ({_IMG})""")
def raster_points(spark, sf_dir):
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    return _image(spark).select(
        "x", "y", raster.clamp(v, 500, 3000).cast("long").alias("clamped"), raster.invert(v).alias("inverted"), raster.threshold(v, 1000, 2000).cast("long").alias("bands"), raster.remap_range(v, 300, 1800).alias("ranged"),
        raster.div(x.cast("long") * 4096, 32).alias("gx"), raster.div(y.cast("long") * 4096, 32).alias("gy"), raster.to_bytes(v).alias("shown"), raster.lookup_curve(v, [(0, 4096), (2048, 1000), (4096, 4000)]).cast("long").alias("curved"),
    )


_PAIR = f"SELECT p.x, p.y, p.v AS a, (4096 - p.v % 4097)::bigint AS b FROM ({_IMG}) p"


@query(f"""
SELECT x, y, mode, v FROM (SELECT x, y, unnest([
  {{'mode': 'add', 'v': a + b}}, {{'mode': 'subtract', 'v': a - b}}, {{'mode': 'multiply', 'v': floor(a * b / 4096)::bigint}}, {{'mode': 'divide', 'v': CASE WHEN b = 0 THEN 4096 ELSE a * 4096 // b END}},
  {{'mode': 'screen', 'v': 4096 - floor((4096 - a) * (4096 - b) / 4096)::bigint}}, {{'mode': 'overlay', 'v': CASE WHEN b < 2048 THEN floor(a * b / 2048)::bigint ELSE 4096 - floor((4096 - a) * (4096 - b) / 2048)::bigint END}},
  {{'mode': 'dodge', 'v': CASE WHEN a = 4096 THEN 4096 ELSE b * 4096 // (4096 - a) END}}, {{'mode': 'burn', 'v': CASE WHEN a = 0 THEN 0 ELSE 4096 - (4096 - b) * 4096 // a END}},
  {{'mode': 'min', 'v': least(a, b)}}, {{'mode': 'max', 'v': greatest(a, b)}}, {{'mode': 'difference', 'v': abs(a - b)}}, {{'mode': 'exclusion', 'v': a + b - floor(a * b / 2048)::bigint}}], recursive := true) FROM ({_PAIR}))""")
def raster_combine(spark, sf_dir):
    a = _image(spark)
    return raster.combine(a, a.withColumn("v", 4096 - F.col("v") % 4097))


@query(f"""
SELECT p.x, p.y, sum(q.v) // 7 AS v FROM ({_IMG}) p JOIN ({_IMG}) q ON q.y = p.y AND least((q.x - p.x + 32) % 32, (p.x - q.x + 32) % 32) <= 3 GROUP BY 1, 2""")
def raster_blur(spark, sf_dir):
    return raster.blur(_image(spark), "x", 32, 3)


@query(f"""
SELECT x, y, (4096 - CASE WHEN len = 0 THEN 0 ELSE 16777216 // greatest(len, 1) END)::bigint AS v FROM (
  SELECT x, y, trunc(4096.0::double * sqrt(((b * b >> 12) + (a * a >> 12) + 4096)::double / 4096.0::double))::bigint AS len FROM (
    SELECT p.x, p.y, (3000 * (r.v - l.v)) >> 12 AS a, (3000 * (d.v - u.v)) >> 12 AS b FROM ({_IMG}) p
    JOIN ({_IMG}) l ON l.y = p.y AND l.x = (p.x + 31) % 32 JOIN ({_IMG}) r ON r.y = p.y AND r.x = (p.x + 1) % 32
    JOIN ({_IMG}) u ON u.x = p.x AND u.y = (p.y + 31) % 32 JOIN ({_IMG}) d ON d.x = p.x AND d.y = (p.y + 1) % 32))""")
def raster_edges(spark, sf_dir):
    return raster.edges(_image(spark), 32, 32, gain=3000)


@query(f"""
SELECT p.x, p.y, f.v AS flipped, t.v AS tiled, k.v AS mirrored, (floor((p.v * (p.x * 128) + f.v * (4096 - p.x * 128)) / 4096))::bigint AS blended FROM ({_IMG}) p
JOIN ({_IMG}) f ON f.x = 31 - p.x AND f.y = p.y JOIN ({_IMG}) t ON t.x = p.x % 8 AND t.y = p.y % 8 JOIN ({_IMG}) k ON k.x = least(p.x, 31 - p.x) AND k.y = least(p.y, 31 - p.y)""")
def raster_moves(spark, sf_dir):
    px, x, y = _image(spark), F.col("x"), F.col("y")
    board = px.select("x", "y")
    flipped = raster.flip(px, 32, 32, True, False)
    tiled, mirrored = raster.resample(px, x % 8, y % 8, board), raster.resample(px, F.least(x, 31 - x), F.least(y, 31 - y), board)
    mask = board.withColumn("v", x.cast("long") * 128)
    blended = raster.blend(px, flipped, mask)
    named = lambda d, n: d.select("x", "y", F.col("v").alias(n))
    return named(flipped, "flipped").join(named(tiled, "tiled"), ["x", "y"]).join(named(mirrored, "mirrored"), ["x", "y"]).join(named(blended, "blended"), ["x", "y"])


@query(f"""
SELECT x, y, (r + g + b) // 3 AS mono, (CASE WHEN k THEN r * 2048 // 4096 ELSE r END)::bigint AS r2, (CASE WHEN k THEN g * 1024 // 4096 ELSE g END)::bigint AS g2, (CASE WHEN k THEN b ELSE b END)::bigint AS b2
FROM (SELECT *, abs(r - 2000) <= 1500 AND abs(g - 2000) <= 1500 AND abs(b - 2000) <= 1500 AS k FROM (SELECT x, y, v AS r, v * 3 % 4097 AS g, v * 7 % 4097 AS b FROM ({_IMG})))""")
def raster_colors(spark, sf_dir):
    v = F.col("v")
    d = _image(spark).select("x", "y", v.alias("r"), (v * 3 % 4097).alias("g"), (v * 7 % 4097).alias("b"))
    c = [F.col(n) for n in "rgb"]
    new = raster.color_key(c, [2000] * 3, 1500, [2048, 1024, 4096])
    return d.select("x", "y", raster.mono(*c).alias("mono"), *[n.alias(f"{k}2") for k, n in zip("rgb", new, strict=True)])


@query(f"""
SELECT x, y, ((4096 - (((((15731 * (n * n % 4294967296) + 789221) % 4294967296) * n + 1376312589) % 2147483648) // 262144)) % 4096)::bigint AS noise, (CASE WHEN (x + CASE WHEN y // 4 % 2 = 1 THEN 4 ELSE 0 END) % 8 < 1 OR y % 4 < 1 THEN 0 ELSE 4096 END)::bigint AS brick,
  (CASE WHEN v BETWEEN 100 AND 900 OR v >= 4000 OR v <= 50 THEN 4096 ELSE 0 END)::bigint AS band
FROM (SELECT *, xor(m, m << 1) AS n FROM (SELECT *, (x * 128 + y * 128 * 57)::bigint AS m FROM ({_IMG})))""")
def raster_patterns(spark, sf_dir):
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    return _image(spark).select(
        "x", "y", raster.hash_noise(x * 128, y * 128).alias("noise"), raster.bricks(x, y, 8, 4, 1).cast("long").alias("brick"), raster.bands(v, [(100, 900), (4000, 50)]).cast("long").alias("band"),
    )
