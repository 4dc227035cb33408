"""Catalog metrics, arrays, positional lists, message dispatch, preferences and coordinate transforms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lookups
from ..sources import load
from .registry import query


@query("SELECT (p_size % 6)::int AS idx, count(DISTINCT p_brand) AS groups, count(*) AS files, (count(*) FILTER (p_retailprice > 1200) * 100 // count(*))::int AS percent, max(p_partkey) AS last FROM part GROUP BY 1")
def archive_catalog(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("idx", (F.col("p_size") % 6).cast("int"))
    percent = F.call_function("div", F.count_if(F.col("p_retailprice") > 1200) * 100, F.count("*")).cast("int")
    return p.groupBy("idx").agg(F.count_distinct("p_brand").alias("groups"), F.count("*").alias("files"), percent.alias("percent"), F.max("p_partkey").alias("last"))


@query("SELECT c_custkey, n_nationkey AS file FROM customer JOIN nation ON lower(n_name) = lower(CASE WHEN c_custkey % 2 = 0 THEN 'Nation_6' ELSE 'nation_11' END)")
def read_by_name(spark, sf_dir):
    wanted = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "Nation_6").otherwise("nation_11").alias("name"))
    files = load(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"), F.col("n_nationkey").alias("file"))
    return wanted.join(files, F.lower("name") == F.col("key")).select("c_custkey", "file")


@query("""
SELECT o_orderkey, len(a)::int AS n, a[2] AS second, (o_orderkey % 5 + 1)::int AS size, list_sum(list_transform(a, lambda v, k: CASE WHEN k = 2 THEN 99 ELSE v END))::bigint AS total
FROM (SELECT o_orderkey, list_transform(range(o_orderkey % 5 + 1), lambda k: -1) AS a FROM orders)""")
def int_arrays(spark, sf_dir):
    size = (F.col("o_orderkey") % 5 + 1).cast("int")
    a = F.array_repeat(F.lit(-1), size)
    put = F.transform(a, lambda v, k: F.when(k == 1, 99).otherwise(v))
    total = F.aggregate(put, F.lit(0).cast("long"), lambda s, v: s + v)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.size(a).alias("n"), F.get(a, F.lit(1)).alias("second"), size.alias("size"), total.alias("total"))


@query("""
SELECT n_regionkey, len(names)::int AS children, names[1] AS first, coalesce(list_position(names, 'NATION_13'), 0)::int - 1 AS named, array_to_string(names, ', ') AS joined
FROM (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1)""")
def phrase_categories(spark, sf_dir):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    c = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(listed.alias("names"))  # a category's children are few
    return c.select("n_regionkey", F.size("names").alias("children"), F.get("names", F.lit(0)).alias("first"), (F.array_position("names", "NATION_13") - 1).cast("int").alias("named"), F.array_join("names", ", ").alias("joined"))


@query("""
SELECT event_type, count(*) AS n, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 40 ELSE 0 END)::bigint AS weight, max_by(value, event_id) AS last FROM events GROUP BY 1""")
def message_dispatch(spark, sf_dir):
    t = F.col("event_type")
    weight = F.when(t == "view", 1).when(t == "click", 2).when(t == "purchase", 40).otherwise(0)
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.max_by("value", "event_id").alias("last"))


@query("""
SELECT event_id, coalesce(r.region, -1)::bigint AS region, coalesce(x - x0 + 1000, -1)::bigint AS rx, coalesce(y - y0 + 2000, -1)::bigint AS ry FROM (SELECT event_id, user_id % 100 AS x, event_id % 120 AS y FROM events) e
LEFT JOIN (SELECT n_nationkey AS region, n_nationkey % 5 * 20 AS x0, n_nationkey // 5 * 20 AS y0 FROM nation WHERE n_nationkey % 3 > 0) r ON x BETWEEN x0 AND x0 + 19 AND y BETWEEN y0 AND y0 + 19""")
def world_to_region(spark, sf_dir):
    points = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("x"), (F.col("event_id") % 120).alias("y"))
    n = F.col("n_nationkey")
    x0, y0 = n % 5 * 20, F.floor(n / 5) * 20
    regions = load(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(n.alias("region"), x0.alias("x0"), (x0 + 19).alias("x1"), y0.alias("y0"), (y0 + 19).alias("y1"))
    hit = lookups.points_in_regions(points, regions, cell=20).select("event_id", "region", (F.col("x") - F.col("x0") + 1000).alias("rx"), (F.col("y") - F.col("y0") + 2000).alias("ry"))
    return points.select("event_id").join(hit, "event_id", "left").select("event_id", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("region", "rx", "ry")])


@query("""
SELECT s_suppkey, (s_suppkey % 7) BETWEEN 0 AND 4 AS valid, CASE WHEN s_suppkey % 7 BETWEEN 0 AND 4 THEN s_suppkey % 7 ELSE 2 END AS value, s_nationkey IN (1, 5, 9) AS supported FROM supplier""")
def preferences(spark, sf_dir):
    v = F.col("s_suppkey") % 7
    return load(spark, sf_dir, "supplier").select("s_suppkey", v.between(0, 4).alias("valid"), F.when(v.between(0, 4), v).otherwise(2).alias("value"), F.col("s_nationkey").isin(1, 5, 9).alias("supported"))


@query("""
SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS next FROM events""")
def cursor_next(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.lead("event_id").over(w), F.lit(-1)).alias("next"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL '30 minutes'""")
def pending_expiry(spark, sf_dir):
    """Writes that aren't hidden by a pending one: none within the last half hour of their key."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = load(spark, sf_dir, "events").withColumn("before", before)
    return e.where(F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("INTERVAL '30' MINUTE"))).select("user_id", "event_id", "event_type")


@query("SELECT a.s_suppkey, ((a.s_suppkey * 7 % 64) & ~7)::bigint AS zone_x, count(b.event_id) AS events FROM supplier a JOIN events b ON b.user_id % 64 BETWEEN (a.s_suppkey * 7 % 64) & ~7 AND ((a.s_suppkey * 7 % 64) & ~7) + 7 GROUP BY 1, 2")
def zone_events(spark, sf_dir):
    """Events by 8-wide zone: counted by zone first, then looked up."""
    zone = lambda x: F.shiftleft(F.shiftright(x, 3), 3)
    counted = load(spark, sf_dir, "events").groupBy(zone(F.col("user_id") % 64).alias("zone_x")).agg(F.count("*").alias("events"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", zone(F.col("s_suppkey") * 7 % 64).alias("zone_x")).join(counted, "zone_x").select("s_suppkey", "zone_x", "events")


@query(None)
def random_ints(spark, sf_dir):
    n = F.col("n_nationkey") + 1
    return load(spark, sf_dir, "nation").select("n_nationkey", F.floor(F.rand(7) * n).cast("int").alias("below"), F.floor(F.rand(8) * (n + 1)).cast("int").alias("upto"))
