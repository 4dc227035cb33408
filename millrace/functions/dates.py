"""Day numbers counted from 2002-02-27 and leap years of both calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "2002-02-27"


def day_number(day: Column, month0: Column, year: Column) -> Column:
    """Days since the epoch of a date whose month counts from 0; -1 before 1970."""
    n = F.datediff(F.make_date(year, month0 + 1, day), F.lit(EPOCH).cast("date"))
    return F.when(year < 1970, -1).otherwise(n)


def day_text(n: Column) -> Column:
    """A day number as d-MMM-yyyy."""
    return F.date_format(F.date_add(F.lit(EPOCH).cast("date"), n), "d-MMM-yyyy")


def minutes_since_epoch(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 60).cast("int")


def is_leap(year: Column) -> Column:
    """Every fourth year before 1582 (a year before Christ counts one on), Gregorian after."""
    y = F.when(year < 0, year + 1).otherwise(year)
    every = lambda n: F.pmod(y, F.lit(n)) == 0
    return F.when(y < 1582, every(4)).otherwise((every(4) & ~every(100)) | every(400)).cast("int")
