"""Bars: last stored versions, repaired prices, re-bucketing on local calendars, market hours, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from quillon.sources.tables import SERIES, plain_pair

NEW_YORK, LONDON = "America/New_York", "Europe/London"


def in_zone(stamp: Column, zone: str) -> Column:
    """Local wall time of a zoneless UTC stamp, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), stamp)


def series_window() -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy("bar_time")


def trailing(n: int, lag: int = 0) -> WindowSpec:
    """The last ``n`` bars up to the current one, or up to ``lag`` bars before it."""
    return series_window().rowsBetween(-(n - 1) - lag, -lag)


def repaired(df: DataFrame) -> DataFrame:
    """Missing open, high, low from the close; high and low widened to hold all four."""
    o, h, l = (F.coalesce(F.col(c), F.col("close")) for c in ("open", "high", "low"))
    return df.withColumns({"open": o, "high": F.greatest(o, h, l, "close"), "low": F.least(o, h, l, "close")})


def latest_bars(prices: DataFrame) -> DataFrame:
    """One bar per series and bar_time: the version stored last, with positive prices, repaired.

    The version is chosen by a partial aggregate, so copies collapse before the shuffle. Rows without a close,
    a bar_time or with a price that is not positive are left out.
    """
    known = prices.where(F.col("close").isNotNull() & F.col("bar_time").isNotNull())
    positive = known.where(F.least("open", "high", "low", "close") > 0)  # least skips nulls
    order = F.struct(F.coalesce("fetched_at", F.lit("1970-01-01").cast("timestamp_ntz")), F.coalesce("line_id", F.lit(-1)))
    chosen = positive.groupBy("root", plain_pair(F.col("pair")).alias("pair"), "tf", "bar_time").agg(F.max_by(F.struct("open", "high", "low", "close"), order).alias("v"))
    return repaired(chosen.select(*SERIES, "bar_time", "v.*"))


def bucketed(df: DataFrame, keys: list[str], at: str, bucket: Column, least: int = 1) -> DataFrame:
    """Bars of each key and bucket: first open, greatest high, least low, last close by time, and their number."""
    return (
        df.groupBy(*keys, bucket.alias("bucket"))
        .agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.count(F.lit(1)).alias("bars"))
        .where(F.col("bars") >= least)
    )


def ticks_to_bars(ticks: DataFrame, key: str, at: str, price: str, tie: str, bucket: Column) -> DataFrame:
    """OHLC of a tick stream; ticks of one instant are ordered by ``tie``."""
    order = F.struct(at, tie)
    return ticks.groupBy(key, bucket.alias("bucket")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("ticks")
    )


def trading_day(local: Column) -> Column:
    """London trading day of a local stamp: Saturday and Sunday count towards Monday."""
    day = F.to_date(local)
    return F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))


def market_open(stamp: Column) -> Column:
    """Sunday 17:00 to Friday 17:00 in New York."""
    local = in_zone(stamp, NEW_YORK)
    day, hour = F.weekday(F.to_date(local)), F.hour(local)
    return ((day <= 3) | ((day == 4) & (hour < 17)) | ((day == 6) & (hour >= 17)))


def bar_end(minutes: Column) -> Column:
    """End of a bar: ``minutes`` after its start, or for daily bars the end of the London day, in UTC."""
    next_midnight = F.date_add(F.to_date("bar_time"), 1).cast("timestamp_ntz")
    london = F.convert_timezone(F.lit(LONDON), F.lit("UTC"), next_midnight)
    return F.when(minutes > 0, F.timestamp_add("MINUTE", minutes, F.col("bar_time"))).otherwise(london)


def log_return_bp(lag: int = 1) -> Column:
    return (F.log("close") - F.log(F.lag("close", lag).over(series_window()))) * 10_000
