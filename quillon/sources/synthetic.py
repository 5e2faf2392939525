"""Made markets: bars that depend on nothing but their name, seed and place, so that a longer run begins as a shorter one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a digest of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(*parts: Column) -> Column:
    """A standard normal number from two digests."""
    return F.sqrt(-2 * F.log(uniform(F.lit("a"), *parts))) * F.cos(2 * math.pi * uniform(F.lit("b"), *parts))


def hourly_bars(pairs: DataFrame, hours: int, seed: int, sd: float = 0.001, block: int = 4096) -> DataFrame:
    """pair, k (hour from 0), open, high, low, close: a random walk an hour, with a range drawn around each bar.

    ``pairs``: pair and ``level`` (first open). Steps are drawn where they lie; the walk is summed within blocks and the
    blocks' sums are run up, so no task walks a pair.
    """
    count = lambda a, z: F.explode(F.sequence(a.cast("long"), z.cast("long")))
    blocks = pairs.where(F.lit(hours > 0)).select("*", count(F.lit(0), F.lit(max(hours - 1, 0) // block)).alias("_b"))
    grid = blocks.select("*", count(F.col("_b") * block, F.least((F.col("_b") + 1) * block, F.lit(hours)) - 1).alias("k"))
    steps = grid.withColumn("_z", sd * normal(F.lit(seed), F.col("pair"), F.col("k")))
    sums = steps.groupBy("pair", "_b").agg(F.sum("_z").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("pair").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    run = F.sum("_z").over(Window.partitionBy("pair", "_b").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walk = steps.withColumn("_run", run).join(sums.select("pair", "_b", before.alias("_ahead")), ["pair", "_b"])
    close = F.col("level") * F.exp(F.col("_ahead") + F.col("_run"))
    bars = walk.withColumns({"close": close, "open": close / F.exp("_z")})
    wide = lambda side: 1 + side * sd / 2 * uniform(F.lit(f"r{side}"), F.lit(seed), F.col("pair"), F.col("k"))
    return bars.select("pair", "k", "open", (F.greatest("open", "close") * wide(1)).alias("high"), (F.least("open", "close") * wide(-1)).alias("low"), "close")
