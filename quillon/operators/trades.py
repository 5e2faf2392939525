"""Path-dependent trades: exits as a relation, non-overlap as a short walk per series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillon.operators.batches import bounds, in_order, whole_groups
from quillon.operators.bars import series_window, trailing
from quillon.sources.tables import SERIES


def entries(bars: DataFrame, width: float = 2.0, hold: int = 5, warm_up: int = 14) -> DataFrame:
    """A trade at each bar's close in the direction of the last five bars, with stop, target and the bars ahead.

    The bars that decide the trade are the next ``hold`` ones: they ride along in the row (a bounded frame), so
    settling needs no join.
    """
    w = series_window()
    df = bars.withColumns({"n": F.row_number().over(w), "atr": F.avg(F.col("high") - F.col("low")).over(trailing(14))})
    df = df.withColumn("d", F.when(F.col("close") >= F.lag("close", 5).over(w), 1).otherwise(-1))
    ahead = F.collect_list(F.struct("open", "high", "low", "close")).over(w.rowsBetween(1, hold))
    df = df.withColumn("ahead", ahead).where(F.col("n") > warm_up)
    step = F.col("d") * width * F.col("atr")
    return df.select(*SERIES, "bar_time", "n", "d", F.col("close").alias("entry"), (F.col("close") - step).alias("sl"), (F.col("close") + step).alias("tp"), "ahead", F.lit(hold).alias("hold"))


def unfolded(trades: DataFrame, grid: list[tuple[float, int]]) -> DataFrame:
    """Each trade with every stop width and holding period of a grid, unfolded in the row: one scan, one set of windows.

    ``trades`` are entries of width 1 that carry as many bars ahead as the longest holding period; adds ``width``.
    """
    settings = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(h).alias("hold")) for w, h in grid))
    each = trades.drop("hold").select("*", F.inline(settings))
    step = F.col("entry") - F.col("sl")
    return each.withColumns({"sl": F.col("entry") - step * F.col("width"), "tp": F.col("entry") + step * F.col("width"), "ahead": F.slice("ahead", F.lit(1), F.col("hold"))})


def settled(trades: DataFrame, *more: str) -> DataFrame:
    """how, bars and r of each trade that is over, and the columns ``more``: in a bar the stop comes before the target, a gap fills at the open."""
    d, sl, tp = F.col("d"), F.col("sl"), F.col("tp")

    def outcome(bar, k):
        against, along = F.when(d > 0, bar["low"]).otherwise(bar["high"]), F.when(d > 0, bar["high"]).otherwise(bar["low"])
        gap_stop, gap_target = d * (bar["open"] - sl) <= 0, d * (bar["open"] - tp) >= 0
        stop, target, late = d * (against - sl) <= 0, d * (along - tp) >= 0, k + 1 == F.col("hold")
        px = F.when(gap_stop | gap_target, bar["open"]).when(stop, sl).when(target, tp).when(late, bar["close"])
        how = F.when(gap_stop, "sl").when(gap_target, "tp").when(stop, "sl").when(target, "tp").when(late, "time")
        return F.struct(px.alias("px"), how.alias("how"), (k + 1).alias("bars"))

    first = F.try_element_at(F.filter(F.transform("ahead", outcome), lambda x: x["px"].isNotNull()), F.lit(1))
    done = trades.withColumn("_x", first).where(F.col("_x").isNotNull())
    r = d * (F.col("_x.px") - F.col("entry")) / F.nullif(F.abs(F.col("entry") - sl), F.lit(0.0))
    return done.select(*SERIES, "bar_time", "n", F.col("_x.how").alias("how"), F.col("_x.bars").alias("bars"), r.alias("r"), *(F.col(c) for c in more), *(["hold"] if more else []))


def one_at_a_time(done: DataFrame) -> DataFrame:
    """The trades taken when a new one is entered only once the last is over (in order, per series)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, SERIES):
            start, end = table.column("n").to_numpy(), table.column("n").to_numpy() + table.column("bars").to_numpy()
            # the trade after one is the first that starts at its end or later: a jump in the series' own stretch of places
            span = int(max(end.max(), start.max())) + 1
            after = np.searchsorted(group * span + start, group * span + end)
            stop = np.searchsorted(group, np.arange(int(group[-1]) + 1), side="right")
            keep, now = np.zeros(len(start), dtype=bool), bounds(group)[0]
            while len(now):
                keep[now] = True
                nxt = after[now]
                now = nxt[nxt < stop[group[now]]]
            yield from table.filter(pa.array(keep)).to_batches()

    rows = in_order(done.select(*SERIES, "bar_time", "n", "how", "bars", "r"), SERIES, "bar_time")
    return rows.mapInArrow(run, rows.schema)


def metrics(kept: DataFrame) -> DataFrame:
    """Per series: trades, win rate, mean and total r, profit factor, exits by reason, greatest drawdown."""
    so_far = series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = kept.withColumn("cum", F.sum("r").over(so_far))
    df = df.withColumn("dd", F.greatest(F.lit(0.0), F.max("cum").over(so_far)) - F.col("cum"))
    gain, loss = F.sum(F.greatest("r", F.lit(0.0))), F.sum(F.greatest(-F.col("r"), F.lit(0.0)))
    return df.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.avg((F.col("r") > 0).cast("double")), 4).alias("win_rate"), F.round(F.avg("r"), 4).alias("avg_r"), F.round(F.sum("r"), 4).alias("total_r"),
        F.round(gain / F.nullif(loss, F.lit(0.0)), 4).alias("profit_factor"), *(F.count_if(F.col("how") == h).alias(f"by_{h}") for h in ("sl", "tp", "time")), F.round(F.max("dd"), 4).alias("max_drawdown"),
    )
