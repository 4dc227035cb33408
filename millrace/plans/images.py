"""Image generators and filters over a small canvas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns, raster
from .registry import query

_IMG = "SELECT (i % 32)::int AS x, (i // 32)::int AS y, ((i % 32 * 37 + i // 32 * 91) * 53 % 4097)::bigint AS v FROM range(1024) t(i)"


def _image(spark):
    return raster.canvas(spark, 32, 32).withColumn("v", ((F.col("x") * 37 + F.col("y") * 91) * 53 % 4097).cast("long"))


_FIXED = "SELECT (i % 64)::int AS x, (i // 64)::int AS y, (i % 64 * 64)::bigint AS u, (i // 64 * 64)::bigint AS w FROM range(4096) t(i)"


@query(f"""
SELECT x, y, (CASE WHEN 585 < u AND 4096 - 585 > u AND w > 2048 - 585 AND w < 2048 + 585 THEN 4096 - abs(2048 - u) * 4096 // (2048 - 585)
    WHEN 2048 - 585 < u AND 585 + 2048 > u THEN (abs(w - 2048) - 585) * 4096 // (2048 - 585)
    WHEN 585 > w OR w > 4096 - 585 THEN (abs(u - 2048) - 585) * 4096 // (2048 - 585)
    WHEN u < 585 OR u > 4096 - 585 THEN 4096 - abs(2048 - w) * 4096 // (2048 - 585) ELSE 0 END)::bigint AS weave,
  (CASE WHEN fy < 204 AND k <> 1 THEN 0 WHEN fy < 204 AND 204 > fx THEN 0 WHEN fy >= 204 AND fx < 204 AND k > 0 THEN 0 ELSE 4096 END)::bigint AS herringbone
FROM (SELECT *, u % (4096 // 5) * 5 AS fx, w % (4096 // 8) * 8 AS fy, (((5 * u >> 12) - (8 * w >> 12)) % 4 + 4) % 4 AS k FROM ({_FIXED}))""")
def raster_weaves(spark, sf_dir):
    x, y = (F.col(c).cast("long") * 64 for c in "xy")
    return raster.canvas(spark, 64, 64).select("x", "y", patterns.weave(x, y, 585).alias("weave"), patterns.herringbone(x, y, 5, 8, 204).alias("herringbone"))


_NEAR = f"""(SELECT p.x, p.y, r.v - l.v AS dx, d.v - u.v AS dy FROM ({_IMG}) p
JOIN ({_IMG}) l ON l.y = p.y AND l.x = (p.x + 31) % 32 JOIN ({_IMG}) r ON r.y = p.y AND r.x = (p.x + 1) % 32
JOIN ({_IMG}) u ON u.x = p.x AND u.y = (p.y + 31) % 32 JOIN ({_IMG}) d ON d.x = p.x AND d.y = (p.y + 1) % 32)"""


@query(f"""
WITH s AS (SELECT x, y, floor(500 * dy / 4096.0::double)::bigint AS a, floor(500 * -dx / 4096.0::double)::bigint AS b FROM {_NEAR}),
t AS (SELECT *, least(abs(floor(b / 16.0::double)::bigint), 255) AS p, least(abs(floor(a / 16.0::double)::bigint), 255) AS q FROM s),
-- the table's rows hold one number more each: the pair at a place of the table
tri AS (SELECT r * (r + 1) // 2 + c AS place, trunc(255.0::double / sqrt((r * r + c * c + 65535)::double / 65535.0::double))::bigint AS inverse FROM range(257) a(r), range(257) b(c) WHERE c <= r),
l AS (SELECT trunc(cos(2000 / 4096.0::double) * sin(3000 / 4096.0::double) * 4096)::bigint AS lx, trunc(cos(2000 / 4096.0::double) * cos(3000 / 4096.0::double) * 4096)::bigint AS ly, trunc(sin(2000 / 4096.0::double) * 4096)::bigint AS lz)
SELECT x, y, floor(floor(inverse * 4096 / 256.0::double) * lz / 4096.0::double)::bigint + floor(floor(inverse * b / 256.0::double) * lx / 4096.0::double)::bigint + floor(floor(a * inverse / 256.0::double) * ly / 4096.0::double)::bigint AS v
FROM t JOIN tri ON place = p + q * (q + 1) // 2, l""")
def raster_emboss(spark, sf_dir):
    return patterns.emboss(_image(spark), 32, 32, 500, 3000, 2000)


@query(f"""
SELECT p.x, p.y, q.v FROM (SELECT x, y, ((x + floor(floor(trunc(4096 * cos(6.283185307179586::double * (k / 255.0::double))) * far / 4096) / 4096)::bigint) % 32 + 32) % 32 AS sx,
    ((y + floor(floor(trunc(4096 * sin(6.283185307179586::double * (k / 255.0::double))) * far / 4096) / 4096)::bigint) % 32 + 32) % 32 AS sy
  FROM (SELECT x, y, (v // 16) & 255 AS k, floor(v * 7 % 4097 * 40000 / 4096.0::double)::bigint AS far FROM ({_IMG}))) p JOIN ({_IMG}) q ON q.x = sx AND q.y = sy""")
def raster_displace(spark, sf_dir):
    px = _image(spark)
    return patterns.displace(px, px, px.select("x", "y", (F.col("v") * 7 % 4097).alias("v")), 32, 32, 40_000)


@query(f"""
WITH s AS (SELECT x, y, dx * 3000 AS dx, dy * 3000 AS dy FROM {_NEAR}),
n AS (SELECT *, floor(4096 * sqrt((floor(a * a / 4096.0::double) + floor(b * b / 4096.0::double) + 4096) / 4096.0::double))::bigint AS len
  FROM (SELECT *, floor(dx / 4096.0::double) AS a, floor(dy / 4096.0::double) AS b FROM s))
SELECT x, y, floor(trunc(dx::double / len) / 2)::bigint + 2048 AS nx, floor(trunc(dy::double / len) / 2)::bigint + 2048 AS ny, floor(trunc(16777216::double / len) / 2)::bigint + 2048 AS nz FROM n""")
def raster_normals(spark, sf_dir):
    return raster.normals(_image(spark), 32, 32, gain=3000, half=True)


@query("""
WITH RECURSIVE c AS (SELECT (i % 64)::int AS x, (i // 64)::int AS y, -9000 + (i % 64 * 64)::bigint * 4096 // 1300 AS re, -6500 + (i // 64 * 64)::bigint * 4096 // 1300 AS im FROM range(4096) t(i)),
w AS (SELECT x, y, re, im, re AS r, im AS i, 0 AS n FROM c UNION ALL
  SELECT x, y, re, im, re + floor(r * r / 4096.0::double)::bigint - floor(i * i / 4096.0::double)::bigint, im + 2 * floor(i * r / 4096.0::double)::bigint, n + 1 FROM w
  WHERE floor(r * r / 4096.0::double) + floor(i * i / 4096.0::double) < 16384 AND n < 40)
SELECT x, y, (CASE WHEN max(n) >= 39 THEN 0 ELSE max(n)::bigint * 4096 // 40 END)::bigint AS v FROM w GROUP BY 1, 2""")
def raster_fractal(spark, sf_dir):
    x, y = (F.col(c).cast("long") * 64 for c in "xy")
    return raster.canvas(spark, 64, 64).withColumn("v", raster.mandelbrot(x, y, 1300, -9000, -6500, 40))


@query(f"""
SELECT x, y, floor((4096 + trunc(4096 * sin(6.283185307179586::double * (((m % 4096 + 4096) % 4096 // 16) / 255.0::double)))) / 2)::bigint AS sine, (d % 4096)::bigint AS saw, ((2048 - abs(d % 4096 - 2048)) * 2)::bigint AS triangle
FROM (SELECT *, trunc(3.141592653589793::double * (5 * trunc(sqrt(floor((a * a + b * b) / 4096.0::double) / 4096.0::double) * 4096)))::bigint AS d
  FROM (SELECT x, y, (u - w) * 3 AS m, floor((u - 2048) / 2.0::double)::bigint AS a, floor((w - 2048) / 2.0::double)::bigint AS b FROM ({_FIXED})))""")
def raster_waves(spark, sf_dir):
    x, y = (F.col(c).cast("long") * 64 for c in "xy")
    return raster.canvas(spark, 64, 64).select("x", "y", raster.wave(x, y, 3, "sine").alias("sine"), raster.wave(x, y, 5, "saw", True).alias("saw"), raster.wave(x, y, 5, "triangle", True).cast("long").alias("triangle"))


def _stop(at: str, k: int) -> str:
    a, b = (0, 400, 4000), (2500, 4096, 100)
    return f"(least(255, greatest(0, floor(floor(({a[k]} * (4096 - ({at}) * 4096 // 2500) + {b[k]} * (({at}) * 4096 // 2500)) / 4096.0::double) / 16)::bigint)) * 16)"


@query(f"""
SELECT x, y, CASE WHEN v % 3 = 0 THEN v * 2000 // 4096 ELSE 2000 END::bigint AS r, CASE WHEN v % 3 = 0 THEN v * 4096 // 4096 ELSE 4096 END::bigint AS g, CASE WHEN v % 3 = 0 THEN v * 1000 // 4096 ELSE 1000 END::bigint AS b,
  {", ".join(f"(CASE WHEN t < 2500 THEN {_stop('t', k)} ELSE {min(255, c // 16) * 16} END)::bigint AS {n}" for k, (n, c) in enumerate((("stop_r", 2500), ("stop_g", 4096), ("stop_b", 100))))}
FROM (SELECT *, least(256, v // 16) * 16 AS t FROM ({_IMG}))""")
def raster_tints(spark, sf_dir):
    """Grey pixels times a tint (others take it whole), and a colour for each value from a table."""
    v = F.col("v")
    tinted = raster.colorize([v, v, v + F.when(v % 3 == 0, 0).otherwise(1)], [2000, 4096, 1000])
    colors = raster.color_gradient(v, [(0, 0, 400, 4000), (2500, 2500, 4096, 100)])
    return _image(spark).select("x", "y", *[c.cast("long").alias(n) for n, c in zip("rgb", tinted, strict=True)], *[c.cast("long").alias(n) for n, c in zip(("stop_r", "stop_g", "stop_b"), colors, strict=True)])


@query("""
WITH c AS (SELECT cx::bigint AS cx, cy::bigint AS cy, (cx * 8 + (cx * 7 + cy * 3 + 5) % 8)::bigint AS px, (cy * 8 + (cx * 5 + cy * 11 + 2) % 8)::bigint AS py FROM range(4) a(cx), range(4) b(cy)),
w AS (SELECT px + 32 * dx AS px, py + 32 * dy AS py FROM c, range(-1, 2) s(dx), range(-1, 2) t(dy))
SELECT x::int AS x, y::int AS y, min((x - px) * (x - px) + (y - py) * (y - py))::bigint AS f1, min(abs(x - px) + abs(y - py))::bigint AS m1 FROM range(32) p(x), range(32) q(y), w GROUP BY 1, 2""")
def raster_cells(spark, sf_dir):
    return patterns.cellular(spark, 32, 8)


@query(None)
def raster_noise(spark, sf_dir):
    return patterns.value_noise(raster.canvas(spark, 64, 64), 64, octaves=4, seed=3)


@query(None)
def raster_hsl(spark, sf_dir):
    v = F.col("v")
    d = _image(spark).select("x", "y", v.alias("r"), (v * 3 % 4097).alias("g"), (v * 7 % 4097).alias("b"))
    r, g, b = patterns.shift_hsl(F.col("r"), F.col("g"), F.col("b"), 512, 300, -200)
    return d.select("x", "y", r.alias("r"), g.alias("g"), b.alias("b"))


@query("""
SELECT x::int AS x, y::int AS y, (CASE WHEN (x BETWEEN 4 AND 11 AND y BETWEEN 6 AND 9) OR (x - 20) * (x - 20) * 16 + (y - 20) * (y - 20) * 64 <= 16 * 64 THEN 4096 ELSE 0 END)::bigint AS v FROM range(32) a(x), range(32) b(y)""")
def raster_shapes(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    inside = patterns.in_rectangle(x, y, 4, 6, 11, 9) | patterns.in_ellipse(x, y, 20, 20, 8, 4)
    return raster.canvas(spark, 32, 32).withColumn("v", F.when(inside, raster.ONE).otherwise(0).cast("long"))
