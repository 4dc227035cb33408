"""Fixed-point images as rows ``(x, y, v)``: 4096 is 1.0; coordinates wrap, so sides are powers of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ONE = 4096


def _shr12(c: Column) -> Column:
    """Arithmetic shift by 12: floor, also below 0."""
    return F.shiftright(c.cast("long"), 12)


def div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def canvas(spark: SparkSession, w: int, h: int) -> DataFrame:
    """All pixels, in as many partitions as Spark likes."""
    i = F.col("id")
    return spark.range(w * h).select((i % w).cast("int").alias("x"), F.floor(i / w).cast("int").alias("y"))


def clamp(v: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(v, F.lit(hi)))


def invert(v: Column) -> Column:
    return ONE - v


def threshold(v: Column, lo: int, hi: int) -> Column:
    return F.when(v.between(lo, hi), ONE).otherwise(0)


def remap_range(v: Column, lo: int, hi: int) -> Column:
    return _shr12(v * (hi - lo)) + lo


def mono(r: Column, g: Column, b: Column) -> Column:
    return div(r + g + b, 3)


def color_key(channels: list[Column], key: list[int], tolerance: int, new: list[int]) -> list[Column]:
    """Pixels near a key colour in every channel take another colour, scaled by their own."""
    near = F.lit(True)
    for c, k in zip(channels, key, strict=True):
        near = near & (F.abs(c - k) <= tolerance)
    return [F.when(near, _shr12(c * n)).otherwise(c) for c, n in zip(channels, new, strict=True)]


def colorize(channels: list[Column], tint: list[int]) -> list[Column]:
    """Grey pixels times a tint; pixels of unequal channels take the tint itself."""
    r, g, b = channels
    grey = (r == g) & (g == b)
    return [F.when(grey, _shr12(c * t)).otherwise(F.lit(t).cast("long")) for c, t in zip(channels, tint, strict=True)]


def color_gradient(v: Column, stops: list[tuple[int, int, int, int]]) -> list[Column]:
    """The three channels of a table of 257 colours between ``stops (value, r, g, b)`` in ascending order, 8 bits each, scaled back to fixed point."""
    at = F.greatest(F.lit(0), F.least(F.lit(256), F.shiftright(v.cast("long"), 4))) * 16
    out = []
    for k in (1, 2, 3):
        c = F.when(at < stops[0][0], stops[0][k])
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            share = div((at - a[0]) * ONE, b[0] - a[0])
            c = c.when(at < b[0], _shr12(a[k] * (ONE - share) + b[k] * share))
        c = F.shiftright(c.otherwise(stops[-1][k]).cast("long"), 4)
        out.append(F.greatest(F.lit(0), F.least(F.lit(255), c)) * 16)
    return out


#: Two inputs' combinations by name.
COMBINE = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: _shr12(a * b),
    "divide": lambda a, b: F.when(b == 0, ONE).otherwise(div(a * ONE, F.when(b == 0, 1).otherwise(b))),
    "screen": lambda a, b: ONE - _shr12((ONE - a) * (ONE - b)),
    "overlay": lambda a, b: F.when(b < ONE // 2, F.shiftright((a * b).cast("long"), 11)).otherwise(ONE - F.shiftright(((ONE - a) * (ONE - b)).cast("long"), 11)),
    "dodge": lambda a, b: F.when(a == ONE, ONE).otherwise(div(b * ONE, F.when(a == ONE, 1).otherwise(ONE - a))),
    "burn": lambda a, b: F.when(a == 0, 0).otherwise(ONE - div((ONE - b) * ONE, F.when(a == 0, 1).otherwise(a))),
    "min": F.least,
    "max": F.greatest,
    "difference": lambda a, b: F.abs(a - b),
    "exclusion": lambda a, b: a + b - F.shiftright((a * b).cast("long"), 11),
}


def combine(left: DataFrame, right: DataFrame, *modes: str) -> DataFrame:
    """Two images combined in some of the ``COMBINE`` modes (all by default): ``(x, y, mode, v)`` from one join."""
    joined = left.join(right.withColumnRenamed("v", "__b"), ["x", "y"])
    each = F.array(*[F.struct(F.lit(m).alias("mode"), COMBINE[m](F.col("v"), F.col("__b")).cast("long").alias("v")) for m in modes or COMBINE])
    return joined.select("x", "y", F.explode(each).alias("c")).select("x", "y", "c.mode", "c.v")


def blend(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """a where the mask is 1.0, b where it is 0."""
    j = a.join(b.withColumnRenamed("v", "__b"), ["x", "y"]).join(mask.withColumnRenamed("v", "__m"), ["x", "y"])
    return j.select("x", "y", _shr12(F.col("v") * F.col("__m") + F.col("__b") * (ONE - F.col("__m"))).alias("v"))


def flip(px: DataFrame, w: int, h: int, horizontal: bool, vertical: bool) -> DataFrame:
    return px.withColumns({**({"x": w - 1 - F.col("x")} if horizontal else {}), **({"y": h - 1 - F.col("y")} if vertical else {})})


def lookup_curve(v: Column, points: list[tuple[int, int]]) -> Column:
    """Piecewise-linear curve through ``points``, constant beyond its ends."""
    out = F.when(v <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points[:-1], points[1:], strict=True):
        out = out.when(v < x1, y0 + div((v - x0) * (y1 - y0), x1 - x0))
    return out.otherwise(points[-1][1])


def resample(px: DataFrame, x: Column, y: Column, spark_canvas: DataFrame) -> DataFrame:
    """Each pixel of a canvas takes the value at the computed place: tiles, mirrors, displacement."""
    source = px.select(F.col("x").alias("__sx"), F.col("y").alias("__sy"), "v")
    wanted = spark_canvas.withColumn("__sx", x.cast("int")).withColumn("__sy", y.cast("int"))
    return wanted.join(source, ["__sx", "__sy"]).select("x", "y", "v")


def _halo(px: DataFrame, axis: str, size: int, r: int) -> DataFrame:
    """Pixels with r wrapped neighbours beyond each end of their line."""
    a = F.col(axis)
    ends = px.where(a < r).withColumn(axis, a + size).union(px.where(a >= size - r).withColumn(axis, a - size))
    return px.union(ends.select(px.columns))


def blur(px: DataFrame, axis: str, size: int, r: int) -> DataFrame:
    """Mean over 2 r + 1 pixels along an axis, wrapping."""
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy(other).orderBy(axis).rowsBetween(-r, r)
    return _halo(px, axis, size, r).withColumn("v", div(F.sum("v").over(w), 2 * r + 1)).where(F.col(axis).between(0, size - 1))


def neighbour_difference(px: DataFrame, axis: str, size: int, name: str) -> DataFrame:
    """The next pixel's value less the one's before, along an axis, wrapping."""
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy(other).orderBy(axis)
    return _halo(px, axis, size, 1).withColumn(name, F.lead("v").over(w) - F.lag("v").over(w)).where(F.col(axis).between(0, size - 1))


def edges(px: DataFrame, w: int, h: int, gain: int = ONE) -> DataFrame:
    """1.0 less the inverse length of a surface's normal whose slopes are the neighbour differences times ``gain``: 0 where flat."""
    g = _slopes(px, w, h)
    dx, dy = _shr12(F.col("dx") * gain), _shr12(F.col("dy") * gain)
    length = (F.sqrt((_shr12(dx * dx) + _shr12(dy * dy) + ONE) / float(ONE)) * float(ONE)).cast("long")
    return g.select("x", "y", (ONE - F.when(length == 0, 0).otherwise(div(F.lit(ONE * ONE), F.greatest(length, F.lit(1))))).alias("v"))


def _slopes(px: DataFrame, w: int, h: int) -> DataFrame:
    g = neighbour_difference(px, "x", w, "dx").select("x", "y", "dx")
    return g.join(neighbour_difference(px, "y", h, "dy").select("x", "y", "dy"), ["x", "y"])


def normals(px: DataFrame, w: int, h: int, gain: int = ONE, half: bool = False) -> DataFrame:
    """Unit normals ``(nx, ny, nz)`` of a height map whose slopes are the neighbour differences times ``gain``; ``half`` halves them around 0.5."""
    g = _slopes(px, w, h).select("x", "y", (F.col("dx") * gain).alias("dx"), (F.col("dy") * gain).alias("dy"))
    a, b = _shr12(F.col("dx")), _shr12(F.col("dy"))
    length = F.floor(F.sqrt((_shr12(a * a) + _shr12(b * b) + ONE) / float(ONE)) * float(ONE)).cast("long")
    part = lambda c: F.when(length == 0, 0).otherwise(div(c, F.greatest(length, F.lit(1))))
    shown = lambda c: F.shiftright(c, 1) + ONE // 2 if half else c
    return g.select("x", "y", *[shown(part(c)).cast("long").alias(n) for n, c in (("nx", F.col("dx")), ("ny", F.col("dy")), ("nz", F.lit(ONE * ONE).cast("long")))])


#: Multiplier of the row, and factors and sums of the cubic.
NOISE_ROW, NOISE = 57, (15731, 789221, 1376312589)


def hash_noise(x: Column, y: Column) -> Column:
    """Noise out of 32-bit integer arithmetic on fixed-point coordinates: a cubic of their mixed bits, its upper bits taken from 1.0; the remainder of 1.0 has the sign of what is divided."""
    n = x.cast("long") + y.cast("long") * NOISE_ROW
    n = n.bitwiseXOR(F.call_function("shiftleft", n, F.lit(1)))
    # only the low 31 bits of the result count, so that products are reduced to 32 bits as they come
    low = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))
    n = low(n)
    cubic = low(low(low(low(n * n) * NOISE[0]) + NOISE[1]) * n) + NOISE[2]
    return (ONE - F.shiftright(cubic.bitwiseAND(F.lit((1 << 31) - 1)), 18)) % ONE


def mandelbrot(x: Column, y: Column, zoom: int, left: int, top: int, rounds: int) -> Column:
    """Escape time of each fixed-point place's point, all in 12-bit fixed point; 0 inside, by a fold over the rounds."""
    re, im = left + div(x.cast("long") * ONE, zoom), top + div(y.cast("long") * ONE, zoom)
    start = F.struct(re.alias("r"), im.alias("i"), F.lit(0).alias("n"))

    def step(s, _):
        rr, ii = _shr12(s["r"] * s["r"]), _shr12(s["i"] * s["i"])
        inside = rr + ii < 4 * ONE
        return F.struct(
            F.when(inside, re + rr - ii).otherwise(s["r"]).alias("r"), F.when(inside, im + _shr12(s["i"] * s["r"]) * 2).otherwise(s["i"]).alias("i"), F.when(inside, s["n"] + 1).otherwise(s["n"]).alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.when(s["n"] >= rounds - 1, 0).otherwise(div(s["n"].cast("long") * ONE, rounds)))


def turn(f, k: Column) -> Column:
    """The k-th of 256 steps of a turn: a sine or cosine in fixed point."""
    return f(F.lit(6.283185307179586) * (k / F.lit(255.0))) * F.lit(float(ONE))


def wave(x: Column, y: Column, frequency: int, kind: str, radial: bool = False) -> Column:
    """Sine, saw or triangle of fixed-point places: along x - y, or by the distance from the middle."""
    if radial:
        a, b = (F.shiftright((c - ONE // 2).cast("long"), 1) for c in (x, y))
        far = (F.sqrt(_shr12(a * a + b * b) / float(ONE)) * float(ONE)).cast("long")
        d = (F.lit(3.141592653589793) * (far * frequency).cast("double")).cast("long")
    else:
        d = ((x - y) * frequency).cast("long")
    p = d.bitwiseAND(F.lit(ONE - 1))
    if kind == "saw":
        return p
    if kind == "triangle":
        return (ONE // 2 - F.abs(p - ONE // 2)) * 2
    return F.shiftright(ONE + turn(F.sin, F.shiftright(p, 4)).cast("long"), 1)


def bricks(x: Column, y: Column, width: int, height: int, joint: int) -> Column:
    """Rows of bricks, every other one shifted by half a brick; 0 in the joints."""
    shifted = F.pmod(x + F.when(F.pmod(F.floor(y / height), F.lit(2)) == 1, width // 2).otherwise(0), F.lit(width))
    return F.when((shifted < joint) | (F.pmod(y, F.lit(height)) < joint), 0).otherwise(ONE)


def bands(v: Column, intervals: list[tuple[int, int]]) -> Column:
    """1.0 inside any of the intervals, wrapping at 1.0."""
    inside = F.lit(False)
    for lo, hi in intervals:
        inside = inside | (v.between(lo, hi) if lo <= hi else (v >= lo) | (v <= hi))
    return F.when(inside, ONE).otherwise(0)


def to_bytes(v: Column) -> Column:
    """Fixed point to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(v.cast("long"), 4))).cast("int")
