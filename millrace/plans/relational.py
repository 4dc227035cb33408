"""Lookups, searches, aggregates and sorts over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, lookups, search, searches, sorting
from ..sources import load
from .registry import query


@query("""
SELECT n_nationkey, n_name, coalesce(r.r_name, 'null') AS region, coalesce(r.r_regionkey, -1)::int AS found
FROM nation LEFT JOIN region r ON r.r_regionkey = n_regionkey + n_nationkey % 3""")
def enum_lookup(spark, sf_dir):
    n = load(spark, sf_dir, "nation").withColumn("key", F.col("n_regionkey") + F.col("n_nationkey") % 3)
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"), F.col("r_regionkey").alias("found"))
    return lookups.enum_lookup(n, r, "key", {"region": "null", "found": -1}).select("n_nationkey", "n_name", "region", "found")


@query("""
SELECT n_regionkey, count(*) AS size, bool_or(n_name = 'NATION_13') AS has_named, bool_or(n_nationkey = 7) AS has_seven FROM nation GROUP BY 1""")
def enum_contains(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return lookups.enum_contains(n, "n_regionkey", {"has_named": ("n_name", "NATION_13"), "has_seven": ("n_nationkey", 7)})


@query("""
SELECT event_id, coalesce(json_extract_string(props, '$.k')::int, -1)::int AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def param_lookup(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    params = lookups.params_of(e, "event_id", "props")
    return lookups.param_lookup(e.select("event_id"), params, "event_id", {"k": ("int", -1), "missing": ("string", "none")})


@query("""
SELECT p.p_partkey, coalesce(q.p_partkey, p.p_partkey) AS variant FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey + 7 AND p.p_size % 2 = 0""")
def self_lookup(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_partkey") + 7).alias("link"))
    return lookups.self_lookup(p, "p_partkey", "link").select("p_partkey", "variant")


@query("""
SELECT e.event_id, e.user_id FROM events e WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c_mktsegment = 'BUILDING')
  AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = e.user_id)""")
def list_membership(spark, sf_dir):
    friends = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    ignored = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return load(spark, sf_dir, "events").join(friends, "user_id", "left_semi").join(ignored, "user_id", "left_anti").select("event_id", "user_id")


@query("""
SELECT c_custkey, lower(c_name) IN (SELECT lower(regexp_replace('<img=1>' || c_name, '^<img=[01]>', '')) FROM customer WHERE c_nationkey = 3)
  OR lower(c_name) IN (SELECT lower(replace(c_name, '1', '2')) FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0) OR lower(c_name) = (SELECT lower(min(c_name)) FROM customer) AS is_friend FROM customer""")
def name_membership(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    previous = F.when(F.col("c_custkey") % 2 == 0, F.upper(F.replace(F.col("c_name"), F.lit("1"), F.lit("2"))))
    listed = c.where("c_nationkey = 3").select(F.concat(F.lit("<img=1>"), "c_name").alias("name"), previous.alias("previous"))
    own = c.agg(F.min("c_name")).first()[0]
    return lookups.is_listed(c, "c_name", listed, "is_friend", own).select("c_custkey", "is_friend")


@query("""
WITH m AS (SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') AND p_size > 10)
SELECT p_partkey, p_name, (row_number() OVER (ORDER BY p_name, p_partkey) - 1)::int AS place FROM m WHERE (SELECT count(*) FROM m) <= 250""")
def part_search(spark, sf_dir):
    return search.search(load(spark, sf_dir, "part"), "p_name", "AN", F.col("p_size") > 10, key="p_partkey", cap=250).select("p_partkey", "p_name", "place")


@query("""
WITH m AS (SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '') AND p_brand = 'Brand#11')
SELECT CASE WHEN count(*) > 50 THEN -1 ELSE count(*) END::int AS found FROM m""")
def search_size(spark, sf_dir):
    return search.search_size(load(spark, sf_dir, "part"), "p_name", "", F.col("p_brand") == "Brand#11", cap=50)


@query("""
WITH m AS (SELECT event_id, event_type FROM events WHERE contains(event_type, 'r') AND json_extract_string(props, '$.k')::int = 42)
SELECT event_id, event_type, (row_number() OVER (ORDER BY event_type, event_id) - 1)::int AS place FROM m WHERE (SELECT count(*) FROM m) <= 1000000""")
def param_search(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    hit = lookups.params_of(e, "event_id", "props").where("param = 'k' and ival = 42").select("event_id")
    return search.search(e.join(hit, "event_id", "left_semi"), "event_type", "R", F.lit(True), key="event_id", cap=1_000_000).select("event_id", "event_type", "place")


@query("""
SELECT l_orderkey, coalesce(sum(CASE WHEN l_suppkey % 5 = 0 THEN l_quantity::bigint END), 0)::bigint AS qty, (28 - count(*) + count(*) FILTER (l_suppkey % 5 = 1))::int AS free FROM lineitem GROUP BY 1""")
def container_counts(spark, sf_dir):
    slots = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_suppkey").alias("item"), F.col("l_quantity").cast("long").alias("qty"))
    return aggregates.container_counts(slots, F.col("item") % 5 == 0, F.col("item") % 5 == 1, capacity=28).select(F.col("container").alias("l_orderkey"), "qty", "free")


@query("""
SELECT l_orderkey, sum(coalesce(p.p_size, 5))::bigint AS total, sum(coalesce(p.p_size, 5) * l_quantity::bigint)::bigint AS weighted
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) p ON p_partkey = l_partkey WHERE l_partkey >= 0 GROUP BY 1""")
def container_params(spark, sf_dir):
    slots = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("qty"))
    params = load(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("value"))
    return aggregates.container_params(slots, params, default=5).select(F.col("container").alias("l_orderkey"), "total", "weighted")


@query("""
SELECT o_custkey, o_orderkey AS best, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def first_largest(spark, sf_dir):
    return aggregates.arg_max(load(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("best"), "o_totalprice")


@query("""
SELECT o_orderpriority, (count(*) FILTER (o_orderstatus = 'F') * 100 // count(*))::int AS percent FROM orders GROUP BY 1""")
def percent_complete(spark, sf_dir):
    return aggregates.percent_complete(load(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("""
SELECT event_type, min(user_id) AS x0, max(user_id) AS x1, min(event_id) AS y0, max(event_id) AS y1 FROM events GROUP BY 1""")
def bounding_boxes(spark, sf_dir):
    return aggregates.bounding_box(load(spark, sf_dir, "events"), ["event_type"], "user_id", "event_id")


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, sum(length(props))::bigint AS bytes FROM events GROUP BY 1""")
def event_rates(spark, sf_dir):
    return aggregates.rates(load(spark, sf_dir, "events"), "ts", "1 hour", F.length("props"))


_WORLDS = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN -1 ELSE (s_acctbal / 10)::int END AS population, n_name AS location,
  CASE WHEN s_suppkey % 4 = 0 THEN '-' ELSE 'act' || s_suppkey % 13 END AS activity, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE (s_suppkey * 37 % 900)::int END AS latency, (s_suppkey % 16)::int AS flags
  FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


def _worlds(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id"), F.when(k % 9 == 0, -1).otherwise(F.round(F.bround(F.col("s_acctbal") / 10, 0)).cast("int")).alias("population"), F.col("n_name").alias("location"),
        F.when(k % 4 == 0, "-").otherwise(F.concat(F.lit("act"), k % 13)).alias("activity"), F.when(k % 7 == 0, -1).otherwise((k * 37 % 900).cast("int")).alias("latency"), (k % 16).cast("int").alias("flags"),
    )


@query(f"""
SELECT id, population, location, (row_number() OVER (ORDER BY nullif(population, -1) ASC NULLS LAST, location DESC, id))::int AS place FROM ({_WORLDS})""")
def world_sort(spark, sf_dir):
    return sorting.world_sort(_worlds(spark, sf_dir), [("population", True), ("location", False)]).select("id", "population", "location", F.col("place").cast("int").alias("place"))


@query(f"""
SELECT id, activity, latency, (row_number() OVER (ORDER BY nullif(activity, '-') DESC NULLS LAST, nullif(latency, -1) ASC NULLS LAST, id))::int AS place FROM ({_WORLDS})""")
def world_sort_activity(spark, sf_dir):
    return sorting.world_sort(_worlds(spark, sf_dir), [("activity", False), ("latency", True)]).select("id", "activity", "latency", F.col("place").cast("int").alias("place"))


@query(f"""
SELECT id, flags, (row_number() OVER (ORDER BY flags & 8 <> 0, flags & 1 <> 0 DESC, id))::int AS place FROM ({_WORLDS})""")
def world_sort_flags(spark, sf_dir):
    return sorting.world_sort(_worlds(spark, sf_dir), [("flag8", True), ("flag1", False)]).select("id", "flags", F.col("place").cast("int").alias("place"))


@query("""
SELECT s_suppkey, s_name, (row_number() OVER (ORDER BY s_key ASC NULLS FIRST, s_suppkey))::int AS place FROM (SELECT *, CASE WHEN s_suppkey % 6 > 0 THEN s_name END AS s_key FROM supplier)""")
def null_first_sort(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").withColumn("key", F.when(F.col("s_suppkey") % 6 > 0, F.col("s_name")))
    return sorting.place(s, F.col("key").asc_nulls_first(), "s_suppkey").select("s_suppkey", "s_name", F.col("place").cast("int").alias("place"))


@query("""
SELECT e.event_id, r.region FROM (SELECT event_id, user_id % 100 AS x, event_id % 100 AS y FROM events) e
JOIN (SELECT n_nationkey AS region, n_nationkey % 5 * 20 AS x0, n_nationkey // 5 * 20 AS y0 FROM nation) r ON x BETWEEN x0 AND x0 + 21 AND y BETWEEN y0 AND y0 + 21""")
def point_in_region(spark, sf_dir):
    points = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).alias("x"), (F.col("event_id") % 100).alias("y"))
    n = F.col("n_nationkey")
    regions = load(spark, sf_dir, "nation").select(n.alias("region"), (n % 5 * 20).alias("x0"), (n % 5 * 20 + 21).alias("x1"), (F.floor(n / 5) * 20).alias("y0"), (F.floor(n / 5) * 20 + 21).alias("y1"))
    return lookups.points_in_regions(points, regions, cell=32).select("event_id", "region")


@query("""
SELECT s.s_suppkey, p.p_partkey AS nearest, p.d2 FROM supplier s LEFT JOIN (
  SELECT s_suppkey, p_partkey, d2, row_number() OVER (PARTITION BY s_suppkey ORDER BY d2, p_partkey) AS k FROM (
    SELECT s_suppkey, p_partkey, (p_partkey % 64 - s_suppkey % 64) * (p_partkey % 64 - s_suppkey % 64) + (p_size - s_nationkey) * (p_size - s_nationkey) AS d2 FROM supplier, part WHERE p_brand = 'Brand#11')) p
  ON p.s_suppkey = s.s_suppkey AND k = 1""")
def nearest_element(spark, sf_dir):
    elements = load(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select("p_partkey", (F.col("p_partkey") % 64).alias("x"), F.col("p_size").alias("y"))
    places = load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 64).alias("x"), F.col("s_nationkey").alias("y"))
    return lookups.nearest(places, "s_suppkey", elements, "p_partkey").select("s_suppkey", F.col("p_partkey").alias("nearest"), "d2")


@query("""
SELECT c_nationkey, c_custkey, c_name, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) - 1)::int AS place FROM customer""")
def positional_rows(spark, sf_dir):
    place = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_name", "c_custkey")) - 1).cast("int")
    return load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", place.alias("place"))


@query("""
SELECT o_orderkey, st & 7 AS status, (st & 8 <> 0) AS sells, (st & 7 = 0) AS empty, (st & 7 = 2) AS pending, (st & 7 = 5) AS done FROM (SELECT o_orderkey, (o_orderkey % 16)::int AS st FROM orders)""")
def offer_status(spark, sf_dir):
    st = (F.col("o_orderkey") % 16).cast("int")
    low = st.bitwiseAND(F.lit(7))
    return load(spark, sf_dir, "orders").select("o_orderkey", low.alias("status"), (st.bitwiseAND(F.lit(8)) != 0).alias("sells"), (low == 0).alias("empty"), (low == 2).alias("pending"), (low == 5).alias("done"))


@query("""
WITH RECURSIVE b AS (SELECT DISTINCT p_partkey % 128 AS x, p_partkey * p_partkey // 7 % 128 AS y FROM part WHERE p_size <= 10),
d AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE dx <> 0 OR dy <> 0),
c AS (SELECT x - dx AS x, y - dy AS y, dx, dy FROM b, d UNION SELECT x - dx, y, dx, dy FROM b, d WHERE dx <> 0 AND dy <> 0 UNION SELECT x, y - dy, dx, dy FROM b, d WHERE dx <> 0 AND dy <> 0),
q AS (SELECT c_custkey AS request, c_custkey * 31 % 128 AS sx, c_custkey * 17 % 128 AS sy, c_custkey * 31 % 128 + c_custkey % 7 - 3 AS tx, c_custkey * 17 % 128 + c_custkey % 11 - 5 AS ty FROM customer),
w AS (SELECT request, sx AS x, sy AS y, 0 AS cost FROM q
  UNION SELECT w.request, w.x + d.dx, w.y + d.dy, w.cost + 1 FROM w JOIN d ON w.cost < 6 LEFT JOIN c ON c.x = w.x AND c.y = w.y AND c.dx = d.dx AND c.dy = d.dy WHERE c.x IS NULL),
r AS (SELECT request, x, y, cost, row_number() OVER (PARTITION BY request ORDER BY (x - tx) * (x - tx) + (y - ty) * (y - ty), cost, x, y) AS k, x = tx AND y = ty AS found FROM w JOIN q USING (request) WHERE x = tx AND y = ty OR abs(x - tx) <= 10 AND abs(y - ty) <= 10 AND cost < 100)
SELECT q.request, r.x, r.y, r.cost, coalesce(r.found, false) AS found FROM q LEFT JOIN r ON r.request = q.request AND r.k = 1""")
def grid_searches(spark, sf_dir):
    """A path of at most six steps for each customer, around cells that parts block."""
    p, c = F.col("p_partkey"), F.col("c_custkey")
    blocked = load(spark, sf_dir, "part").where("p_size <= 10").select((p % 128).alias("x"), (F.floor(p * p / 7) % 128).alias("y"))
    sx, sy = c * 31 % 128, c * 17 % 128
    requests = load(spark, sf_dir, "customer").select(c.alias("request"), sx.alias("sx"), sy.alias("sy"), (sx + c % 7 - 3).alias("tx"), (sy + c % 11 - 5).alias("ty"))
    return searches.grid_searches(requests, blocked, 6)


@query("""
SELECT item_id AS container, ((coalesce(sum((quantity::BIGINT * 100000007) % 4294967296) FILTER (flag = 'kept'), 0) + 2147483648) % 4294967296 - 2147483648)::INT AS qty FROM sale_lines GROUP BY 1""")
def wrapped_sums(spark, sf_dir):
    """Sums by item that wrap at 32 bits; a null item is a container like any other."""
    slots = load(spark, sf_dir, "sale_lines").select(F.col("item_id").alias("container"), F.col("flag").alias("item"), (F.col("quantity").cast("long") * 100_000_007).alias("qty"))
    return aggregates.wrapped_sums(slots, F.col("item") == "kept")


@query("""
SELECT s.sale_id, s.client_id, coalesce(c.city, '-') AS city, coalesce(c.seq, -1) AS seq FROM sales s LEFT JOIN client_changes c ON c.client_id = s.client_id""")
def lookup_with_duplicates(spark, sf_dir):
    """Each sale with every change of its client: keys that come several times are all found, those that don't are defaulted."""
    changes = load(spark, sf_dir, "client_changes").select("client_id", "city", "seq")
    return lookups.enum_lookup_spread(load(spark, sf_dir, "sales").select("sale_id", "client_id"), changes, "client_id", {"city": "-", "seq": -1})


@query("""
WITH w AS (SELECT DISTINCT source, city FROM clients), e AS (SELECT source, city, count(*) AS n FROM client_changes GROUP BY 1, 2)
SELECT w.source, w.city, coalesce(e.n, 0) AS n FROM w LEFT JOIN e ON e.source = w.source AND e.city = w.city""")
def enum_contains_any(spark, sf_dir):
    """How often the changes of each source have each city that its clients have."""
    return lookups.enum_contains_any(load(spark, sf_dir, "client_changes"), "source", "city", load(spark, sf_dir, "clients"))


@query(f"""
SELECT id, flags, (row_number() OVER (ORDER BY flags & 4 <> 0 DESC, flags & 2 <> 0, id))::int AS place FROM ({_WORLDS})""")
def world_sort_more_flags(spark, sf_dir):
    return sorting.world_sort(_worlds(spark, sf_dir), [("flag4", False), ("flag2", True)]).select("id", "flags", F.col("place").cast("int").alias("place"))
