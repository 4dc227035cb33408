"""32-bit integer arithmetic on columns: wrapping, truncating and saturating as a 32-bit machine does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -(1 << 31), (1 << 31) - 1


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def wrap32(x) -> Column:
    """The low 32 bits, signed."""
    return ((_long(x) + (1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int")


def add32(a, b) -> Column:
    return wrap32(_long(a) + _long(b))


def sub32(a, b) -> Column:
    return wrap32(_long(a) - _long(b))


def mul32(a, b) -> Column:
    return wrap32(_long(a) * _long(b))


def quotient(a, b) -> Column:
    """Long division toward zero; an error for divisor 0."""
    return F.call_function("div", _long(a), _long(b))


def div32(a, b) -> Column:
    return wrap32(quotient(a, b))


def mod32(a, b) -> Column:
    """Remainder with the dividend's sign."""
    return wrap32(_long(a) % _long(b))


def saturate32(x: Column) -> Column:
    """A double cut to the 32-bit range, toward zero; not-a-number is 0."""
    return F.when(F.isnan(x), 0).otherwise(F.greatest(F.lit(float(LOW)), F.least(F.lit(float(HIGH)), x)).cast("long")).cast("int")


def lerp32(y0, y1, x0, x1, x) -> Column:
    """The value at x on the line through (x0, y0) and (x1, y1)."""
    return add32(y0, quotient(mul32(sub32(y1, y0), sub32(x, x0)), sub32(x1, x0)))


def add_percent(x, percent) -> Column:
    return wrap32(_long(x) + quotient(_long(x) * _long(percent), 100))


def scale32(a, b, c) -> Column:
    """a * c / b, multiplied in 64 bits."""
    return wrap32(quotient(_long(a) * _long(c), b))


def power32(a: Column, b: Column) -> Column:
    return F.when(a == 0, 0).otherwise(saturate32(F.pow(a.cast("double"), b.cast("double"))))


def integer_power32(a: Column, b: Column) -> Column:
    """a to the b-th power, wrapped to 32 bits: squares of a by the bits of b; exponents below 1 give 1."""
    def step(s, k):
        odd = F.call_function("shiftright", b.cast("long"), k).bitwiseAND(F.lit(1)) == 1
        return F.struct(F.when(odd, mul32(s["out"], s["square"])).otherwise(s["out"]).alias("out"), mul32(s["square"], s["square"]).alias("square"))

    start = F.struct(F.lit(1).cast("int").alias("out"), wrap32(a).alias("square"))
    return F.when(b < 1, F.lit(1)).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(30)), start, step, lambda s: s["out"]))


def root32(a: Column, b: Column) -> Column:
    """The b-th root; of 0 it is 0, and the 0-th of others is the largest integer."""
    return F.when(a == 0, 0).when(b == 0, HIGH).otherwise(saturate32(F.pow(a.cast("double"), F.lit(1.0) / F.when(b == 0, 1).otherwise(b))))


def _bit(b) -> Column:
    """1 << b, of which only the low 5 bits count."""
    return F.call_function("shiftleft", F.lit(1), F.col(b) if isinstance(b, str) else b)


def set_bit(x: Column, b: Column) -> Column:
    return x.cast("int").bitwiseOR(_bit(b))


def clear_bit(x: Column, b: Column) -> Column:
    return x.cast("int").bitwiseAND(F.bitwise_not(_bit(b)))


def test_bit(x: Column, b: Column) -> Column:
    return F.when(x.cast("int").bitwiseAND(_bit(b)) != 0, 1).otherwise(0)


def pack_coordinate(plane: Column, x: Column, y: Column) -> Column:
    return wrap32(_long(plane) * (1 << 28) + _long(x) * (1 << 14) + _long(y))


def unpack_coordinate(v: Column) -> dict[str, Column]:
    """plane keeps the sign, x and y have 14 bits."""
    return {"plane": F.shiftright(v, 28), "x": F.shiftright(v, 14).bitwiseAND(F.lit(16383)), "y": v.bitwiseAND(F.lit(16383))}


def field_mask(lo: Column, hi: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (hi - lo + 1).cast("int")) - 1


def read_field(v: Column, lo: Column, hi: Column) -> Column:
    """Bits lo to hi of a 32-bit value."""
    return wrap32(F.call_function("shiftrightunsigned", v.cast("int"), lo.cast("int")).cast("long").bitwiseAND(field_mask(lo, hi)))


def write_field(v: Column, lo: Column, hi: Column, value: Column) -> Column:
    """Replaces bits lo to hi; a value that doesn't fit writes 0."""
    mask = field_mask(lo, hi)
    fit = F.when((value < 0) | (value > mask), 0).otherwise(value).cast("long")
    shift = lo.cast("int")
    gone = F.bitwise_not(F.call_function("shiftleft", mask, shift))
    return wrap32(_long(v).bitwiseAND(gone).bitwiseOR(F.call_function("shiftleft", fit.bitwiseAND(mask), shift)))
