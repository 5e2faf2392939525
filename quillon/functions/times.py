"""Instants as whole microseconds, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_US = 86_400_000_000


def micros(stamp: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a zoneless timestamp; null stays null."""
    second = (F.extract(F.lit("SECOND"), stamp) * F.lit(1_000_000)).cast("long")
    minutes = F.hour(stamp).cast("long") * 60 + F.minute(stamp)
    return F.unix_date(F.to_date(stamp)).cast("long") * F.lit(DAY_US) + minutes * F.lit(60_000_000) + second


def floor_div(value: Column, by: Column | int) -> Column:
    """Whole quotient rounded down, exact for every bigint within 2**53 multiples."""
    by = F.lit(by) if isinstance(by, int) else by
    return ((value - F.pmod(value, by)) / by).cast("long")


def day_number(micro: Column) -> Column:
    """Calendar day (days since 1970-01-01) of an instant in microseconds."""
    return floor_div(micro, DAY_US).cast("int")


def day_text(number: Column) -> Column:
    """yyyy-MM-dd of a day number."""
    return F.date_format(F.date_from_unix_date(number), "yyyy-MM-dd")
