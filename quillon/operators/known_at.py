"""Problem 3: attributes as they were known at an event's time, by snapshots and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions.times import DAY_US, floor_div, micros
from quillon.sources.tables import plain_pair

PERIOD_DAYS = 32


def as_known(changes: DataFrame, events: DataFrame, entity: list[str], period: int) -> DataFrame:
    """The greatest ``state`` of an entity among the changes visible strictly before each event.

    ``changes``: entity, ``seen`` (bigint, instant from which the change is visible) and ``state`` (a struct;
    greater supersedes). ``events``: entity and ``at`` (bigint), distinct. Out: entity, ``at``, ``state``;
    events before any change are left out.

    Snapshots: for each entity and each ``period`` that holds events, the state known when the period began,
    carried over from the periods with changes before it. Change log: the changes by period. Each event meets
    its period's snapshot and replays only the changes of that period that came before it: a running maximum
    over (entity, period), so that a hot entity is split by its periods and no log is gathered in memory.

    Nulls: changes with a null entity, ``seen`` or ``state`` are never known; events with a null entity or
    ``at`` get nothing. Equal states are one. Empty tables give an empty result.
    """
    keyed = [F.col(c).isNotNull() for c in entity]
    for k in keyed:
        changes, events = changes.where(k), events.where(k)
    part = floor_div(F.col("seen"), period)
    log = changes.where(F.col("seen").isNotNull() & F.col("state").isNotNull()).select(*entity, part.alias("period"), "seen", "state")
    log = log.groupBy(*entity, "period", "seen").agg(F.max("state").alias("state"))  # copies collapse before the shuffle
    asked = events.where(F.col("at").isNotNull()).select(*entity, floor_div(F.col("at") - 1, period).alias("period"), "at")
    nothing = F.lit(None).cast(log.schema["state"].dataType)
    ends = log.groupBy(*entity, "period").agg(F.max("state").alias("state")).unionByName(asked.select(*entity, "period").distinct().withColumn("state", nothing))
    ends = ends.groupBy(*entity, "period").agg(F.max("state").alias("state"))
    before = Window.partitionBy(*entity).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    snapshots = ends.select(*entity, "period", F.max("state").over(before).alias("state")).where(F.col("state").isNotNull())
    steps = (
        snapshots.select(*entity, "period", F.lit(-(2**63)).cast("long").alias("moment"), F.lit(0).alias("ask"), "state")
        .unionByName(log.select(*entity, "period", F.col("seen").alias("moment"), F.lit(1).alias("ask"), "state"))
        .unionByName(asked.select(*entity, "period", F.col("at").alias("moment"), F.lit(-1).alias("ask"), nothing.alias("state")))
    )
    # an event sorts before the changes of its own instant: those are not yet known
    replay = Window.partitionBy(*entity, "period").orderBy("moment", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = steps.withColumn("state", F.max("state").over(replay))
    return known.where((F.col("ask") == -1) & F.col("state").isNotNull()).select(*entity, F.col("moment").alias("at"), "state")


def rate_changes(rates: DataFrame) -> DataFrame:
    """Change log of ``rates``: an observation is visible once stored and once its day has begun.

    An event at the end of a day sees observations of that day, so the observation's own condition turns into
    an instant just before the day's end.
    """
    in_force = (F.unix_date("obs_date").cast("long") + 1) * F.lit(DAY_US) - 1
    stored = micros(F.col("fetched_at"))
    good = rates.where(F.col("value").isNotNull() & F.col("obs_date").isNotNull() & F.col("fetched_at").isNotNull() & F.col("rate_id").isNotNull())
    state = F.struct(F.col("obs_date"), stored.alias("stored"), F.col("rate_id"), F.col("sid"), F.col("value"))
    return good.select("root", "cur", F.greatest(stored, in_force).alias("seen"), state.alias("state"))


def daily_bars(prices: DataFrame) -> DataFrame:
    """Each daily bar twice, once for each currency of its pair, with the instant at which the bar ended."""
    pair = plain_pair(F.col("pair"))
    bars = prices.where((F.col("tf") == "1d") & F.col("bar_time").isNotNull()).select("line_id", "root", pair.alias("pair"), (micros(F.col("bar_time")) + F.lit(DAY_US)).alias("at"))
    both = F.array(F.substring("pair", 1, 3), F.substring("pair", 4, 3))
    return bars.select("line_id", "root", "at", F.explode(both).alias("cur"))


def rates_at_bars(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """For each daily bar and currency the rate known when the bar ended: line_id, cur, rate_id, sid, value.

    Events are the distinct (root, currency, instant); the rows that share one, copies too, are joined to its
    answer afterwards, so neither a hot root nor a bar stored many times makes a long replay.
    """
    bars = daily_bars(prices)
    events = bars.select("root", "cur", "at").distinct()
    known = as_known(rate_changes(rates), events, ["root", "cur"], PERIOD_DAYS * DAY_US)
    return bars.join(known, ["root", "cur", "at"]).select("line_id", "cur", F.col("state.rate_id").alias("rate_id"), F.col("state.sid").alias("sid"), F.col("state.value").alias("value"))
