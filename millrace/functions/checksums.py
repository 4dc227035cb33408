"""Checksums and name hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .int32 import wrap32


def crc32_signed(data: Column) -> Column:
    """CRC-32 as a signed 32-bit integer."""
    return wrap32(F.crc32(data))


def polynomial_hash(s: Column) -> Column:
    """The polynomial in 31 of the character codes, modulo 2**32, signed."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    low = F.lit((1 << 32) - 1)
    return wrap32(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(low)))


def polynomial_hash64(s: Column) -> Column:
    """The same modulo 2**64, signed: two halves of 32 bits, so that nothing overflows."""
    low = F.lit((1 << 32) - 1)

    def step(h, c):
        small = h["low"] * 31 + c
        return F.struct((h["high"] * 31 + F.shiftright(small, 32)).bitwiseAND(low).alias("high"), small.bitwiseAND(low).alias("low"))

    start = F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, start, step, lambda h: F.call_function("shiftleft", h["high"], F.lit(32)).bitwiseOR(h["low"]))
