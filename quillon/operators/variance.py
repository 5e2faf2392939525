"""Realised, range and exponentially weighted variance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.operators import recursive as R
from quillon.operators.bars import LONDON, NEW_YORK, in_zone, market_open, series_window, trading_day, trailing
from quillon.sources.tables import SERIES


def parkinson() -> Column:
    """Range variance of a bar; unknown where high is not above low."""
    return F.when(F.col("high") > F.col("low"), F.pow(F.log(F.col("high") / F.col("low")), 2) / (4 * math.log(2)))


def realised(moves: DataFrame) -> DataFrame:
    """Sum of squared moves per pair and London trading day, without each pair's first (partial) day."""
    day = trading_day(in_zone(F.col("bar_time"), LONDON))
    sums = moves.where(F.col("x").isNotNull()).groupBy("root", "pair", day.alias("day")).agg(F.sum(F.col("x") * F.col("x")).alias("rv"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("_first", F.min("day").over(Window.partitionBy("root", "pair"))).where(F.col("day") > F.col("_first")).drop("_first")


def day_measures(moves: DataFrame) -> DataFrame:
    """n, rv, absr, rq (root of the quarticity), ret and park per pair and day, in one aggregate."""
    x = F.col("x")
    d = moves.where(x.isNotNull()).groupBy("root", "pair", F.to_date("bar_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("rv"), F.sum(F.abs(x)).alias("absr"), F.sum(x * x * x * x).alias("q"), F.sum(x).alias("ret"), F.max("high").alias("h"), F.min("low").alias("l")
    )
    return d.withColumns({"rq": F.sqrt(F.col("n") / 3 * F.col("q")), "park": F.pow(F.log(F.col("h") / F.col("l")) * 10_000, 2) / (4 * math.log(2))}).drop("q", "h", "l")


def har(days: DataFrame) -> DataFrame:
    """Trailing means of 1, 5 and 22 days and the next day's value."""
    order = Window.partitionBy("root", "pair").orderBy("day")
    mean = lambda n: F.when(F.count("rv").over(order.rowsBetween(-(n - 1), 0)) >= n, F.avg("rv").over(order.rowsBetween(-(n - 1), 0)))
    return days.withColumns({"d1": F.col("rv"), "d5": mean(5), "d22": mean(22), "target": F.lead("rv").over(order)})


def range_scale(moves: DataFrame, n: int = 250, least: int = 50) -> DataFrame:
    df = moves.withColumn("_p", parkinson() * 1e8)
    both = F.col("_p").isNotNull() & F.col("x").isNotNull()
    w = trailing(n)
    ratio = F.sum(F.when(both, F.col("x") * F.col("x"))).over(w) / F.nullif(F.sum(F.when(both, F.col("_p"))).over(w), F.lit(0.0))
    return df.withColumn("ratio", F.when(F.sum(both.cast("int")).over(w) >= least, ratio)).drop("_p")


def ewma_variance(moves: DataFrame, decay: float = 0.94, revert: float = 0.9, n: int = 500) -> DataFrame:
    """Exponentially weighted variance of the moves, drawn towards the variance of the last ``n``."""
    df = moves.withColumn("_q", F.col("x") * F.col("x"))
    df = R.exponential(df, {"_e": ("_q", 1 - decay, 20)})
    long = F.var_pop("x").over(trailing(n))
    return df.withColumn("variance", F.col("_e") * revert + long * (1 - revert)).drop("_q", "_e")


def path_ahead(used: DataFrame, steps: int, minutes: int, decay: float = 0.97, keep: float = 0.985, gap_hours: float = 2.0) -> DataFrame:
    """root, pair, k (1..steps), slot and variance of the next open slots after each series' last bar.

    ``used``: slotted moves of one timeframe (see ``season.slotted``). Squared moves over the profile of their time of day
    have a level now (decayed mean, begun with that of the first twenty) and a long one (last 1,500); the level goes back
    to the long one by ``keep`` a step, times the slot's profile; a closed gap before a slot adds ``gap_hours`` hours.
    """
    from quillon.operators.season import profile

    shape = profile(used).select(*SERIES, "tod", "profile")
    u = used.join(shape, [*SERIES, "tod"]).select(*SERIES, "bar_time", (F.col("x") * F.col("x") / F.col("profile")).alias("_u"))
    n = F.row_number().over(series_window())
    u = u.withColumn("_n", n).withColumns({"_first": F.avg("_u").over(trailing(20)), "_long": F.avg("_u").over(trailing(1500))})
    level = R.exponential(u.withColumn("_seen", F.when(F.col("_n") == 20, F.col("_first")).when(F.col("_n") > 20, F.col("_u"))), {"_e": ("_seen", 1 - decay, 1)})
    last = level.groupBy(*SERIES).agg(F.max_by(F.struct("_e", "_long"), "bar_time").alias("v"), F.timestamp_add("MINUTE", F.lit(minutes), F.max("bar_time")).alias("origin")).select(*SERIES, "origin", "v.*").where(F.col("_e").isNotNull())
    ahead = last.select("*", F.explode(F.sequence("origin", F.timestamp_add("DAY", F.lit(6), F.col("origin")), F.expr(f"INTERVAL {minutes} MINUTES"))).alias("slot")).where(market_open(F.col("slot")))
    order = Window.partitionBy(*SERIES).orderBy("slot")
    ahead = ahead.withColumns({"k": F.row_number().over(order).cast("long"), "_was": F.coalesce(F.timestamp_add("MINUTE", F.lit(minutes), F.lag("slot").over(order)), F.col("origin"))}).where(F.col("k") <= steps)
    local = in_zone(F.col("slot"), NEW_YORK)
    ahead = ahead.withColumn("tod", F.floor((F.hour(local) * 60 + F.minute(local)) / minutes).cast("long")).join(shape, [*SERIES, "tod"], "left")
    gap = F.when(F.col("slot") > F.col("_was"), gap_hours * 60 / minutes * F.col("_long")).otherwise(0.0)
    value = (F.col("_long") + (F.col("_e") - F.col("_long")) * F.pow(F.lit(keep), F.col("k"))) * F.coalesce("profile", F.lit(1.0)) + gap
    return ahead.select(*SERIES, "k", "slot", value.alias("variance"))
