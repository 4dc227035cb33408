"""Deltas and lists of records, sorts by keys, timeouts, sparse updates and coarse positions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import checksums, int32
from ..operators import aggregates, sorting, state
from ..sources import load
from ..sources.archive import container, read_flat
from .registry import query


@query("""
WITH d AS (SELECT o_custkey % 1200 AS id, CASE WHEN o_orderkey % 11 = 0 THEN 65535 ELSE o_orderkey * 7 % 2001 END AS population, o_orderkey AS seq FROM orders),
l AS (SELECT id, arg_max(population, seq) AS population FROM d GROUP BY 1)
SELECT s_suppkey AS id, (CASE WHEN l.population = 65535 THEN -1 ELSE coalesce(l.population, s_nationkey) END)::bigint AS population FROM supplier LEFT JOIN l ON l.id = s_suppkey""")
def world_populations(spark, sf_dir):
    worlds = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("population"))
    k = F.col("o_orderkey")
    deltas = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 1200).alias("id"), F.when(k % 11 == 0, 65535).otherwise(k * 7 % 2001).alias("population"), k.alias("seq"))
    return state.populations(worlds, deltas, ["seq"]).select("id", "population")


@query("SELECT o_orderkey, key, (row_number() OVER (ORDER BY key, o_orderkey))::int AS place FROM (SELECT o_orderkey, (o_totalprice * 100)::bigint * 4294967296 AS key FROM orders)")
def long_key_sort(spark, sf_dir):
    """Rows by a 64-bit key, ascending."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.bround(F.col("o_totalprice") * 100).cast("long") * (1 << 32)).alias("key"))
    return sorting.place(o, "key", "o_orderkey").withColumn("place", F.col("place").cast("int"))


@query("SELECT l_orderkey, l_linenumber, key, (row_number() OVER (ORDER BY key, l_orderkey, l_linenumber))::int AS place FROM (SELECT *, (l_partkey % 1000 - 500)::int AS key FROM lineitem)")
def int_key_sort(spark, sf_dir):
    """Rows by a 32-bit key, ascending; many rows tie."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1000 - 500).cast("int").alias("key"))
    return sorting.place(rows, "key", "l_orderkey", "l_linenumber").withColumn("place", F.col("place").cast("int"))


@query("""
SELECT user_id, event_id, depth, (row_number() OVER (PARTITION BY user_id ORDER BY depth, event_id) - 1)::int AS place FROM (SELECT user_id, event_id, (event_id % 37 * 100 - user_id)::int AS depth FROM events)""")
def depth_sort(spark, sf_dir):
    """Each scene's nodes by depth, ascending."""
    nodes = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 37 * 100 - F.col("user_id")).cast("int").alias("depth"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("depth", "event_id")) - 1
    return nodes.withColumn("place", place)


@query("""
SELECT c_custkey, coalesce(b.best, -1)::bigint AS best FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1) b ON o_custkey = c_custkey""")
def first_largest_or_none(spark, sf_dir):
    """Each customer's first largest order, -1 for those without."""
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    best = aggregates.arg_max(load(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", customers, -1)
    return best.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("best"))


@query("""
SELECT c_custkey, coalesce(p.percent, 100)::int AS percent FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') * 100 // count(*) AS percent FROM orders GROUP BY 1) p ON o_custkey = c_custkey""")
def percent_of_all(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    done = aggregates.percent_complete(load(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", customers)
    return done.select(F.col("o_custkey").alias("c_custkey"), "percent")


@query("""
WITH f AS (SELECT event_type, user_id, min(event_id) AS first, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
SELECT event_type, user_id, (k - 1)::int AS place, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first) AS k FROM f) WHERE k <= 100""")
def member_list_of_100(spark, sf_dir):
    return state.first_members(load(spark, sf_dir, "events"), ["event_type"], "user_id", ["event_id"], ["value"], 100)


@query("""
SELECT o_orderkey, CASE WHEN (closed IS NULL OR closed > sweep) AND sweep <= TIMESTAMP '1998-01-01' THEN sweep END AS dropped FROM (
  SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN opened + INTERVAL 1 SECOND * (o_orderkey % 4) END AS closed,
    make_timestamp((floor(epoch(opened))::bigint + 2) * 1000000) AS sweep FROM (SELECT *, o_orderdate::timestamp + INTERVAL 1 SECOND * (o_orderkey % 60) AS opened FROM orders))""")
def two_strike_sweeps(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("opened", F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 60))
    o = o.withColumn("closed", F.when(F.col("o_custkey") % 7 > 0, F.col("opened") + F.make_dt_interval(secs=F.col("o_orderkey") % 4)))
    return state.two_strikes(o, "o_orderkey", "opened", "closed", 1, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", F.col("dropped").cast("timestamp_ntz").alias("dropped"))


@query("""
WITH g AS (SELECT user_id, event_id, ts, event_type = 'view' AS answer, least(coalesce(epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000, 0), 86400000) AS gap, sum((event_type = 'view')::int) OVER w AS span
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, waited::bigint AS waited FROM (SELECT *, sum(CASE WHEN answer THEN 0 ELSE gap END) OVER (PARTITION BY user_id, span ORDER BY ts, event_id) AS waited FROM g) WHERE waited > 100000000""")
def stalled_requests(spark, sf_dir):
    """Users without an answer (a view) for so long; a gap counts a day at most."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.stalls(e, ["user_id"], "ts", ["ts", "event_id"], F.col("event_type") == "view", 86_400_000, 100_000_000).select("user_id", "event_id", "waited")


@query("""
SELECT tick, slot, pass, CASE WHEN (row_number() OVER (PARTITION BY tick, pass ORDER BY slot) - 1) % 4 = 0 THEN slot * 3 END AS value FROM (
  SELECT (o_custkey % 50)::bigint AS tick, o_orderkey AS slot, (CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END END)::int AS pass FROM orders)""")
def skipped_passes(spark, sf_dir):
    """Every fourth slot of a pass updated, those between skipped in runs."""
    k = F.col("o_orderkey")
    slots = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("tick"), k.alias("slot"), (k % 2 == 0).alias("in_view"), (k % 3 == 0).alias("was_active"))
    number = F.when(F.col("in_view"), F.when(F.col("was_active"), 1).otherwise(0)).otherwise(F.when(F.col("was_active"), 2).otherwise(3))
    w = Window.partitionBy("tick", "pass")
    placed = slots.withColumn("pass", number).withColumn("at", F.row_number().over(w.orderBy("slot")) - 1).withColumn("left", F.count("*").over(w) - F.col("at") - 1)
    one = F.struct((F.col("at") * 2).alias("k"), F.lit(None).cast("int").alias("skip"), (F.col("slot") * 3).alias("value"))
    run = F.when(F.col("left") > 0, F.struct((F.col("at") * 2 + 1).alias("k"), (F.least(F.col("left"), F.lit(3)) - 1).cast("int").alias("skip"), F.lit(None).cast("long").alias("value")))
    updates = placed.where("at % 4 = 0").select("tick", "pass", F.explode(F.array_compact(F.array(one, run))).alias("u")).select("tick", "pass", "u.*")
    return state.skip_passes(slots, updates)


@query("""
WITH m AS (SELECT user_id, event_id, event_id % 4 AS kind, event_id % 3 AS plane, event_id % 17 - 8 AS dx, event_id % 13 - 6 AS dy, event_id % 8 AS d, event_id % 64 AS x, event_id * 3 % 64 AS y FROM events),
s AS (SELECT user_id, event_id, kind, x, y, CASE WHEN kind = 0 THEN 0 ELSE plane END AS p,
  CASE kind WHEN 2 THEN ([-1, 0, 1, -1, 1, -1, 0, 1])[d + 1] WHEN 3 THEN dx ELSE 0 END AS a, CASE kind WHEN 2 THEN ([-1, -1, -1, 0, 0, 1, 1, 1])[d + 1] WHEN 3 THEN dy ELSE 0 END AS b FROM m),
t AS (SELECT *, ((sum(p) OVER w) % 4 + 4) % 4 AS rp, ((sum(a) OVER w) % 256 + 256) % 256 AS rx, ((sum(b) OVER w) % 256 + 256) % 256 AS ry FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, rp::int AS region_plane, rx::int AS region_x, ry::int AS region_y, (CASE WHEN kind = 0 THEN x + rx * 64 END)::int AS tile_x, (CASE WHEN kind = 0 THEN y + ry * 64 END)::int AS tile_y FROM t""")
def coarse_positions(spark, sf_dir):
    i = F.col("event_id")
    moves = load(spark, sf_dir, "events").select(
        "user_id", "event_id", (i % 4).alias("kind"), (i % 3).alias("plane"), (i % 17 - 8).alias("dx"), (i % 13 - 6).alias("dy"), (i % 8).cast("int").alias("direction"), (i % 64).alias("x"), (i * 3 % 64).alias("y")
    )
    return state.coarse_regions(moves, "user_id", "event_id").select("user_id", "event_id", "region_plane", "region_x", "region_y", "tile_x", "tile_y")


@query("""
SELECT a.l_orderkey, a.l_linenumber, (CASE WHEN e < 1 THEN 1 ELSE ((list_reduce(list_prepend(1::hugeint, list_transform(range(greatest(e, 0)), lambda k: b::hugeint)), lambda p, v: (p * v) % 4294967296) + 2147483648 + 4294967296) % 4294967296 - 2147483648) END)::int AS power
FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 41 - 20)::int AS b, (l_suppkey % 23 - 2)::int AS e FROM lineitem) a""")
def integer_powers(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 41 - 20).cast("int").alias("b"), (F.col("l_suppkey") % 23 - 2).cast("int").alias("e"))
    return rows.select("l_orderkey", "l_linenumber", int32.integer_power32(F.col("b"), F.col("e")).alias("power"))


@query("""
SELECT c_custkey, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::bigint AS hash FROM (SELECT c_custkey,
  list_reduce(list_prepend(0::hugeint, list_transform(string_split(c_name, ''), lambda c: ascii(c)::hugeint)), lambda h, c: (h * 31 + c) % 18446744073709551616::hugeint) AS h FROM customer)""")
def name_hashes_64(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", checksums.polynomial_hash64(F.col("c_name")).alias("hash"))


@query("""
SELECT c_custkey, (CASE WHEN c_nationkey = 3 THEN k ELSE k + (SELECT count(*) FROM customer WHERE c_nationkey = 3) END)::bigint AS place FROM (
  SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer WHERE c_nationkey IN (3, 7))""")
def spliced_lists(spark, sf_dir):
    """One list moved behind another."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long") - 1
    c = load(spark, sf_dir, "customer").where("c_nationkey in (3, 7)").withColumn("place", place)
    return state.splice(*(c.where(F.col("c_nationkey") == n).select("c_custkey", "place") for n in (3, 7)), "place")


@query("""
SELECT event_id FROM events WHERE NOT (user_id % 5 <= 1 AND user_id IN (SELECT s_suppkey FROM supplier))""")
def suppressed_messages(spark, sf_dir):
    messages = load(spark, sf_dir, "events").withColumn("privilege", F.col("user_id") % 5)
    ignored = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return state.without_ignored(messages, "user_id", "privilege", ignored).select("event_id")


@query("""
SELECT l_orderkey, l_linenumber, a = b AS eq, a <> b AS ne, a < b AS lt, a > b AS gt, a <= b AS le, a >= b AS ge FROM (SELECT *, l_partkey % 7 AS a, l_suppkey % 7 AS b FROM lineitem)""")
def comparisons(spark, sf_dir):
    a, b = F.col("l_partkey") % 7, F.col("l_suppkey") % 7
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (a == b).alias("eq"), (a != b).alias("ne"), (a < b).alias("lt"), (a > b).alias("gt"), (a <= b).alias("le"), (a >= b).alias("ge"))


@query("SELECT (p_partkey)::int AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT s_suppkey * 3 FROM supplier)")
def read_flat_ids(spark, sf_dir):
    """Single-file groups, each in a container (plain, bzip2 or deflated by turns), read by flat id."""

    def pack(batches):
        for batch in batches:
            kinds = [k % 3 for k in batch.column("grp").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array([container(n.encode(), k) for n, k in zip(batch.column("p_name").to_pylist(), kinds, strict=True)], pa.binary())], names=["grp", "raw"])

    groups = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("grp"), "p_name").mapInArrow(pack, "grp int, raw binary")
    ids = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).cast("int").alias("id"))
    return read_flat(groups, ids).select("id", F.col("data").cast("string").alias("name"))
