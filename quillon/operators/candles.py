"""Forecast candles of daily series: sizes from the level and weekday of ranges, shapes from the most typical past situation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from quillon.operators.batches import bounds, in_order, whole_groups
from quillon.operators.recursive import side_by_side
from quillon.sources.tables import SERIES


@dataclass(frozen=True)
class Shape:
    """Lengths and weights of the method."""

    pattern: int = 20  # bars that a situation is made of
    nearest: int = 30  # situations that are looked at
    decay: float = 0.94  # of the variance of moves
    level: float = 0.95  # of the level of ranges
    profile: int = 500  # past bars behind a usual size
    cases: int = 20  # bars of a weekday from which it has a size of its own
    warm_up: int = 200


def smoothed(x: np.ndarray, group: np.ndarray, alpha: float, start: np.ndarray) -> np.ndarray:
    """Exponential averages of all groups side by side, from ``start`` (one a group)."""
    seen = np.ones((1, len(start)), dtype=np.int64)
    return side_by_side(x[None, :], group, np.array([alpha]), np.array([0]), start[None, :], seen)[0]


def sizes(ranges: np.ndarray, level: np.ndarray, weekday: np.ndarray, ahead: np.ndarray, s: Shape) -> np.ndarray:
    """Usual range of each step: the median ratio of a range to the level so many bars before, on that weekday, times the level now."""
    now, out = len(ranges) - 1, np.empty(len(ahead))
    for j, day in enumerate(ahead):
        past = np.arange(min(s.warm_up, now // 2), now - j)
        past = past[level[past] > 0]
        own = past[weekday[past + 1 + j] == day][-s.profile :]
        used = own if len(own) >= s.cases else past[-s.profile :]
        out[j] = level[now] * (np.median(ranges[used + 1 + j] / level[used]) if len(used) else 1.0)
    return out


def typical(z: np.ndarray, y: np.ndarray, sigma: np.ndarray, steps: int, s: Shape) -> int | None:
    """End of the past situation whose continuation stands for those of the nearest ones.

    Situations are the last moves in units of the volatility before them, recent ones weighing more; the chosen ones are
    more than ``steps`` bars apart. The continuation nearest to their mean is the one nearest to all others together.
    """
    now = len(y) - 1
    windows = sliding_window_view(z, s.pattern)
    ends = np.arange(s.pattern + 60, now - steps)
    if len(ends) < s.nearest or not np.isfinite(windows[-1]).all():
        return None
    rows = windows[ends - s.pattern + 1]
    far = np.nansum((rows - windows[-1]) ** 2 * np.linspace(0.5, 1.5, s.pattern), axis=1)
    far[~np.isfinite(rows).all(axis=1)] = np.inf
    chosen = []
    while len(chosen) < s.nearest and np.isfinite(far.min()):
        best = int(far.argmin())
        chosen.append(best)
        far[max(best - steps, 0) : best + steps + 1] = np.inf
    at = ends[chosen]
    after = (y[at[:, None] + np.arange(1, steps + 1)] - y[at][:, None]) / sigma[at][:, None]
    return int(at[((after - after.mean(axis=0)) ** 2).sum(axis=1).argmin()])


def drawn(open_: np.ndarray, parts: np.ndarray, size: np.ndarray, target: float | None) -> np.ndarray:
    """Log prices of candles that open at the close before: ``parts`` are close, top and bottom in units of the range,
    and a target for the end is reached by tilting all candles in proportion to their size."""
    tilt = np.zeros(len(size)) if target is None or size.sum() <= 0 else (target - open_ - (parts[:, 0] * size).sum()) * size / size.sum()
    close = open_ + np.cumsum(parts[:, 0] * size + tilt)
    opens = np.r_[open_, close[:-1]]
    top = np.maximum.reduce([opens + parts[:, 1] * size, opens, close])
    bottom = np.minimum.reduce([opens + parts[:, 2] * size, opens, close])
    return np.column_stack([opens, top, bottom, close])


def forecast_candles(bars: DataFrame, steps: int, s: Shape = Shape(), target: str | None = None) -> DataFrame:
    """root, pair, tf, k (1..steps), open, high, low, close: the candles after the last bar of each daily series.

    ``target`` is a column with the log price that the path should end at, read at the last bar (null: none). Series with
    fewer than pattern + steps + warm_up bars, or without enough past situations, give no rows. Series go whole to a task,
    side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, SERIES):
            price = np.log(np.column_stack([table.column(c).to_numpy() for c in ("open", "high", "low", "close")]))
            weekday, goal = table.column("_day").to_numpy(), table.column("_goal").to_numpy(zero_copy_only=False).astype(float)
            first, length = bounds(group)
            y = price[:, 3]
            move = np.diff(y, prepend=y[:1])
            move[first] = 0.0
            early = np.array([np.mean(move[a : a + min(50, n)] ** 2) for a, n in zip(first, length)])
            sigma = np.sqrt(smoothed(move**2, group, 1 - s.decay, early))
            ranges = np.where(np.isfinite(price[:, 1] - price[:, 2]), np.maximum(price[:, 1] - price[:, 2], 0.0), 0.0)
            none = np.zeros(len(first))
            level = smoothed(ranges, group, 1 - s.level, none) / smoothed(np.ones(len(y)), group, 1 - s.level, none)
            rows, made = [], []
            for a, n in zip(first, length):
                if n < s.pattern + steps + s.warm_up:
                    continue
                part = slice(a, a + n)
                sig = np.where(sigma[part] > 0, sigma[part], np.nan)
                at = typical(move[part] / np.r_[np.nan, sig[:-1]], y[part], sig, steps, s)
                if at is None:
                    continue
                k = a + at + np.arange(1, steps + 1)
                before, inside = y[k - 1], price[k]
                top, bottom = np.maximum(inside.max(axis=1), before), np.minimum(inside.min(axis=1), before)
                span = top - bottom
                unit = np.where(span > 0, span, 1.0)[:, None]
                still = np.array([0.0, 0.5, -0.5])
                parts = np.where((span > 0)[:, None], np.column_stack([y[k] - before, top - before, bottom - before]) / unit, still)
                ahead = (weekday[a + n - 1] + np.arange(1, steps + 1)) % 5  # the next business days
                size = sizes(ranges[part], level[part], weekday[part], ahead, s)
                end = goal[a + n - 1]
                made.append(drawn(y[a + n - 1], parts, size, None if np.isnan(end) else end))
                rows.append(a)
            if rows:
                out = table.select(SERIES).take(pa.array(np.repeat(rows, steps)))
                out = out.append_column("k", pa.array(np.tile(np.arange(1, steps + 1), len(rows)).astype(np.int32)))
                for name, x in zip(("open", "high", "low", "close"), np.exp(np.concatenate(made)).T):
                    out = out.append_column(name, pa.array(x))
                yield from out.to_batches()

    goal = F.lit(None).cast("double") if target is None else F.col(target).cast("double")
    kept = bars.where(F.weekday("bar_time") < 5).select(*SERIES, "bar_time", "open", "high", "low", "close", F.weekday("bar_time").cast("long").alias("_day"), goal.alias("_goal"))
    return in_order(kept, SERIES, "bar_time").mapInArrow(run, "root string, pair string, tf string, k int, open double, high double, low double, close double")
