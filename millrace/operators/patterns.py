"""Generated patterns, displacement and colour shifts on fixed-point images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import ONE, _shr12, _slopes, canvas, div, resample, turn


def weave(x: Column, y: Column, border: int) -> Column:
    """Two crossing strands on fixed-point coordinates, brightest where each passes over the other; ``border`` is half a strand's distance from the edge."""
    half = ONE // 2
    from_x, from_y, reach = F.abs(x - half), F.abs(y - half), half - border
    crossing_y, crossing_x = from_y < border, from_x < border
    return (
        F.when((x > border) & (x < ONE - border) & crossing_y, ONE - div(from_x * ONE, reach)).when(crossing_x, div((from_y - border) * ONE, reach))
        .when((y < border) | (y > ONE - border), div((from_x - border) * ONE, reach)).when((x < border) | (x > ONE - border), ONE - div(from_y * ONE, reach)).otherwise(0).cast("long")
    )


def herringbone(x: Column, y: Column, columns: int, rows: int, joint: int) -> Column:
    """Blocks of two cells that lie and stand by turns on fixed-point coordinates; 0 in the joints."""
    step = F.pmod(F.shiftright((x * columns).cast("long"), 12) - F.shiftright((y * rows).cast("long"), 12), F.lit(4))
    left, top = x % (ONE // columns) * columns < joint, y % (ONE // rows) * rows < joint
    return F.when(top & ((step != 1) | left), 0).when(~top & left & (step > 0), 0).otherwise(ONE).cast("long")


def light_vector(azimuth: int, elevation: int) -> tuple[int, int, int]:
    """Unit vector towards a light by angles in fixed-point radians."""
    up = math.cos(elevation / ONE)
    v = [int(up * math.sin(azimuth / ONE) * ONE), int(up * math.cos(azimuth / ONE) * ONE), int(math.sin(elevation / ONE) * ONE)]
    size = int(ONE * math.sqrt(sum(x * x >> 12 for x in v) >> 12))
    return tuple(int(x * ONE / size) for x in v) if size else tuple(v)


def emboss(px: DataFrame, w: int, h: int, strength: int, azimuth: int, elevation: int) -> DataFrame:
    """A height map's brightness under a light: the light's product with the normals.

    The inverse lengths of normals come from a triangular table by the 8-bit slopes, whose place for a steeper x than y is that of another pair.
    """
    lx, ly, lz = light_vector(azimuth, elevation)
    g = _slopes(px, w, h)
    by_y, by_x = _shr12(F.col("dy") * strength), _shr12(-F.col("dx") * strength)
    a, b = (F.least(F.abs(F.shiftright(c, 4)), F.lit(255)) for c in (by_x, by_y))
    place = a + F.shiftright(b * (b + 1), 1)
    row = F.floor((F.sqrt(place * 8.0 + 1) - 1) / 2).cast("long")
    column = place - F.shiftright(row * (row + 1), 1)
    inverse = (F.lit(255.0) / F.sqrt((row * row + column * column + 65535) / 65535.0)).cast("long")
    parts = [_shr12(F.shiftright(c.cast("long"), 8) * k) for c, k in ((inverse * ONE, lz), (inverse * by_x, lx), (by_y * inverse, ly))]
    return g.select("x", "y", sum(parts[1:], parts[0]).cast("long").alias("v"))


def displace(px: DataFrame, angle: DataFrame, distance: DataFrame, w: int, h: int, reach: int) -> DataFrame:
    """Each pixel takes the value at an angle (a turn in 256 steps, by the upper bits of 1.0) and a distance that two other images say, wrapping."""
    moved = angle.withColumnRenamed("v", "__a").join(distance.withColumnRenamed("v", "__d"), ["x", "y"])
    k, far = F.shiftright("__a", 4).bitwiseAND(F.lit(255)), _shr12(F.col("__d") * reach)
    go = lambda f: _shr12(_shr12(turn(f, k).cast("long") * far))
    return resample(px, F.pmod(F.col("x") + go(F.cos), F.lit(w)), F.pmod(F.col("y") + go(F.sin), F.lit(h)), moved)


def cellular(spark: SparkSession, size: int, cell: int) -> DataFrame:
    """Distance from each pixel to the nearest feature point, squared Euclidean and Manhattan; one point a cell, wrapping.

    A pixel meets the points of the cells within two of its own only, by an equi-join on the cell.
    """
    n = size // cell
    cx, cy = F.col("cx"), F.col("cy")
    cells = canvas(spark, n, n).select(F.col("x").cast("long").alias("cx"), F.col("y").cast("long").alias("cy"))
    points = cells.select("cx", "cy", (cx * cell + (cx * 7 + cy * 3 + 5) % cell).alias("px"), (cy * cell + (cx * 5 + cy * 11 + 2) % cell).alias("py"))
    near = F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)])
    px = canvas(spark, size, size).withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near))
    tx, ty = F.floor(F.col("x") / cell) + F.col("__dx"), F.floor(F.col("y") / cell) + F.col("__dy")
    px = px.withColumn("__tx", tx).withColumn("__ty", ty).withColumn("cx", F.pmod(F.col("__tx"), F.lit(n)).cast("long")).withColumn("cy", F.pmod(F.col("__ty"), F.lit(n)).cast("long"))
    joined = px.join(points, ["cx", "cy"])
    dx = F.col("x") - (F.col("px") + (F.col("__tx") - cx) * cell)
    dy = F.col("y") - (F.col("py") + (F.col("__ty") - cy) * cell)
    return joined.groupBy("x", "y").agg(F.min(dx * dx + dy * dy).cast("long").alias("f1"), F.min(F.abs(dx) + F.abs(dy)).cast("long").alias("m1"))


def _lattice(x: Column, y: Column, seed: int) -> Column:
    """A lattice point's value from 0 to 1."""
    return F.pmod(F.xxhash64(x.cast("long"), y.cast("long"), F.lit(seed)), F.lit(65536)) / 65535.0


def value_noise(px: DataFrame, size: int, octaves: int, seed: int) -> DataFrame:
    """Smooth noise: lattice values interpolated, octaves of double frequency and half weight summed, wrapping."""
    total, weight = F.lit(0.0), 0.0
    for o in range(octaves):
        n = 4 << o
        fx, fy = F.col("x") * (n / size), F.col("y") * (n / size)
        x0, y0 = F.floor(fx), F.floor(fy)
        smooth = lambda t: t * t * (3.0 - t * 2.0)
        u, v = smooth(fx - x0), smooth(fy - y0)
        at = lambda a, b: _lattice((x0 + a) % n, (y0 + b) % n, seed + o)  # noqa: B023, E731
        low, high = at(0, 0) * (1.0 - u) + at(1, 0) * u, at(0, 1) * (1.0 - u) + at(1, 1) * u
        total, weight = total + (low * (1.0 - v) + high * v) * 0.5**o, weight + 0.5**o
    return px.withColumn("v", F.floor(total * (ONE / weight)).cast("long"))


def shift_hsl(r: Column, g: Column, b: Column, hue: int, saturation: int, lightness: int) -> list[Column]:
    """Hue, saturation and lightness moved by fixed-point amounts; hue wraps, the others clamp."""
    top, low = F.greatest(r, g, b) / float(ONE), F.least(r, g, b) / float(ONE)
    spread, light = top - low, (top + low) / 2.0
    sat = F.when(spread == 0, 0.0).otherwise(spread / F.when(light <= 0.5, F.greatest(top + low, F.lit(1e-12))).otherwise(F.greatest(2.0 - top - low, F.lit(1e-12))))
    safe = F.when(spread == 0, 1.0).otherwise(spread) * float(ONE)
    turn = F.when(spread == 0, 0.0).when((r >= g) & (r >= b), (g - b) / safe).when(g >= b, 2.0 + (b - r) / safe).otherwise(4.0 + (r - g) / safe) / 6.0
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    turn, sat, light = F.pmod(turn + hue / ONE, F.lit(1.0)), unit(sat + saturation / ONE), unit(light + lightness / ONE)
    high = F.when(light <= 0.5, light * (1.0 + sat)).otherwise(light + sat - light * sat)
    base = 2.0 * light - high

    def channel(offset: float) -> Column:
        t = F.pmod(turn + offset, F.lit(1.0))
        c = F.when(t < 1 / 6, base + (high - base) * 6.0 * t).when(t < 0.5, high).when(t < 2 / 3, base + (high - base) * (2 / 3 - t) * 6.0).otherwise(base)
        return F.floor(c * ONE).cast("long")

    return [channel(1 / 3), channel(0.0), channel(-1 / 3)]


def in_rectangle(x: Column, y: Column, x0: int, y0: int, x1: int, y1: int) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def in_ellipse(x: Column, y: Column, cx: int, cy: int, rx: int, ry: int) -> Column:
    return (x - cx) * (x - cx) * (ry * ry) + (y - cy) * (y - cy) * (rx * rx) <= rx * rx * ry * ry
