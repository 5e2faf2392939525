"""Problem 1: totals over trailing calendar periods, including days without activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.times import day_number, day_text, micros
from quillon.sources.tables import SERIES, few, of_series, small


def first_and_last(daily: DataFrame, entity: list[str]) -> DataFrame:
    return daily.groupBy(*entity).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def rolling_totals(daily: DataFrame, entity: list[str], totals: list[str], periods: list[int], only: Column | None = None) -> DataFrame:
    """Totals of each entity over the trailing ``periods`` (in days, the day itself included).

    ``daily`` has one row per entity and ``day`` (int, days since 1970) with the columns ``totals``. Out comes
    one row per entity and calendar day from its first to its last day: the entity, ``day``, ``first_day`` and
    ``{total}_{period}`` for each total and period, 0 where nothing happened. ``only`` keeps some of the rows.

    Each daily total is exploded onto every day it influences (the longest period, no later than the entity's
    last day), grouped by entity and day, and the calendar rows are joined for the zeros. The daily totals are
    first brought together by entity, so that the exploded rows are grouped in place: only one row a day
    crosses the network, however many rows a day had, and a hot entity is no more than its calendar.

    Null totals count as 0; rows with a null ``day`` have no place and give nothing; null entities are an
    entity; an empty table gives an empty result; other columns are dropped.
    """
    longest = max(periods)
    daily = daily.where(F.col("day").isNotNull()).select(*entity, "day", *totals).repartition(*entity)
    spans = first_and_last(daily, entity)
    marks = [f"_{i}" for i in range(len(entity))]
    spans = spans.select(*(F.col(c).alias(m) for c, m in zip(entity, marks)), "first_day", "last_day")
    same = [daily[c].eqNullSafe(spans[m]) for c, m in zip(entity, marks)]
    ends = daily.join(spans, _all(same)).drop(*marks)
    reach = F.least(F.col("day") + F.lit(longest - 1), F.col("last_day"))
    spread = ends.select(*entity, *totals, "day", F.explode(F.sequence("day", reach)).alias("out_day"))
    age = F.col("out_day") - F.col("day")
    sums = [F.sum(F.when(age < p, F.coalesce(F.col(t), F.lit(0)))).alias(f"{t}_{p}") for t in totals for p in periods]
    grouped = spread.groupBy(*entity, "out_day").agg(*sums)
    calendar = spans.select(*(F.col(m).alias(c) for c, m in zip(entity, marks)), "first_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    if only is not None:
        calendar = calendar.where(only)
    grouped = grouped.select(*(F.col(c).alias(m) for c, m in zip(entity, marks)), "out_day", *(f"{t}_{p}" for t in totals for p in periods))
    met = [calendar[c].eqNullSafe(grouped[m]) for c, m in zip(entity, marks)]
    full = calendar.join(grouped, _all([*met, F.col("day") == F.col("out_day")]), "left")
    zero = [F.coalesce(F.col(f"{t}_{p}"), F.lit(0)).alias(f"{t}_{p}") for t in totals for p in periods]
    return full.select(*entity, "day", "first_day", *zero)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def bar_counts(prices: DataFrame) -> DataFrame:
    """Distinct bars with a close per series and calendar day: ``day``, ``bars``.

    Copies and revisions of a bar collapse before the shuffle (map-side); a series' day holds its bars only.
    """
    at = micros(F.col("bar_time"))
    bars = of_series(prices.where(F.col("close").isNotNull() & F.col("bar_time").isNotNull()), at.alias("at")).distinct()
    return bars.withColumn("day", day_number(F.col("at"))).groupBy(*SERIES, "day").agg(F.count(F.lit(1)).alias("bars"))


def daily_bar_totals(prices: DataFrame) -> DataFrame:
    """Per series and day: ``bars`` and ``span`` (sum of high - low) over the last stored version of each bar.

    The last version is the one with the greatest ``fetched_at``, then ``line_id``, among those with a close;
    an unknown high or low adds nothing to the span.
    """
    known = prices.where(F.col("close").isNotNull() & F.col("bar_time").isNotNull())
    version = F.struct(F.coalesce(micros(F.col("fetched_at")), F.lit(-(2**62))).alias("f"), F.coalesce("line_id", F.lit(-1)).alias("l"), F.coalesce(F.col("high") - F.col("low"), F.lit(0.0)).alias("span"))
    latest = of_series(known, micros(F.col("bar_time")).alias("at"), version.alias("v")).groupBy(*SERIES, "at").agg(F.max("v").alias("v"))
    return latest.withColumn("day", day_number(F.col("at"))).groupBy(*SERIES, "day").agg(F.count(F.lit(1)).alias("bars"), F.sum("v.span").alias("span"))


def thin_days(prices: DataFrame) -> DataFrame:
    """Calendar days on which the last 7 days held relatively fewer bars than the last 30 (p1_found)."""
    full = F.col("day") >= F.col("first_day") + 29
    totals = rolling_totals(bar_counts(prices), SERIES, ["bars"], [7, 30], only=full)
    return totals.where(F.lit(60) * F.col("bars_7") < F.lit(7) * F.col("bars_30")).select(*SERIES, day_text(F.col("day")).alias("day"))


def trailing_bars(prices: DataFrame, timeframes: DataFrame) -> DataFrame:
    """Totals and averages of bars and ranges over 7, 30 and the timeframe's horizons, one row per period."""
    own = timeframes.where(F.col("tf").isNotNull()).select("tf", F.explode("horizons").alias("h")).where(F.col("h") > 0)
    periods = sorted({7, 30} | {r.h for r in few(own.select("h").distinct())})
    wanted = small(own.groupBy("tf").agg(F.collect_set("h").alias("_own")))
    totals = rolling_totals(daily_bar_totals(prices), SERIES, ["bars", "span"], periods)
    asked = lambda p: F.lit(True) if p in (7, 30) else F.array_contains("_own", p)
    each = F.array_compact(F.array(*(F.when(asked(p), F.struct(F.lit(p).alias("days"), F.col(f"bars_{p}").cast("long").alias("bars"), F.col(f"span_{p}").cast("double").alias("span"))) for p in periods)))
    rows = totals.join(wanted, "tf", "left").select(*SERIES, day_text(F.col("day")).alias("day"), F.inline(each))
    return rows.select(*SERIES, "day", "days", "bars", F.round("span", 6).alias("span_total"), F.round(F.col("bars") / F.col("days"), 9).alias("bars_a_day"), F.round(F.col("span") / F.col("days"), 9).alias("span_a_day"))
