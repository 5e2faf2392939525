"""Indicators over trailing bars that need no memory beyond their window."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillon.operators.bars import series_window, trailing


def gated(value: Column, counted: str, n: int, lag: int = 0) -> Column:
    """``value`` once the window holds ``n`` known values."""
    return F.when(F.count(counted).over(trailing(n, lag)) >= n, value)


def sma(column: str, n: int) -> Column:
    return gated(F.avg(column).over(trailing(n)), column, n)


def bollinger(column: str, n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, sd = sma(column, n), gated(F.stddev_pop(column).over(trailing(n)), column, n)
    return {"bb_lower": mid - width * sd, "bb_mid": mid, "bb_upper": mid + width * sd}


def highest(n: int, lag: int = 0) -> Column:
    return gated(F.max("high").over(trailing(n, lag)), "high", n, lag)


def lowest(n: int, lag: int = 0) -> Column:
    return gated(F.min("low").over(trailing(n, lag)), "low", n, lag)


def donchian(n: int = 20) -> dict[str, Column]:
    """Of the ``n`` bars before each bar."""
    return {"don_high": highest(n, 1), "don_low": lowest(n, 1)}


def place_in_range(n: int, flat: float, scale: float, from_top: bool) -> Column:
    top, bottom = highest(n), lowest(n)
    part = (top - F.col("close")) if from_top else (F.col("close") - bottom)
    return F.when(top.isNull(), None).when(top - bottom > 0, scale * part / F.nullif(top - bottom, F.lit(0.0))).otherwise(flat)


def williams_r(n: int = 14) -> Column:
    return place_in_range(n, -50.0, -100.0, True)


def roc(n: int = 12) -> Column:
    return 100 * (F.col("close") / F.lag("close", n).over(series_window()) - 1)


def ichimoku(short: int = 9, middle: int = 26, long: int = 52) -> dict[str, Column]:
    mid = lambda n: (highest(n) + lowest(n)) / 2
    return {"tenkan": mid(short), "kijun": mid(middle), "span_a": (mid(short) + mid(middle)) / 2, "span_b": mid(long)}


def cci(n: int = 20) -> Column:
    """Typical price against its mean in mean absolute deviations about that mean; not decomposable, so over the window's values."""
    typical = "typical"
    held = F.collect_list(typical).over(trailing(n))
    mean = F.avg(typical).over(trailing(n))
    spread = F.aggregate(held, F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / n
    return gated(F.when(spread > 1e-12, (F.col(typical) - mean) / (0.015 * spread)), typical, n)


def true_range(first_known: bool) -> Column:
    """With the previous close; on the first bar high - low, or nothing where ``first_known`` is false."""
    previous = F.lag("close").over(series_window())
    full = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))
    return full if first_known else F.when(previous.isNotNull(), full)


def pivots(high: Column, low: Column, close: Column) -> dict[str, Column]:
    p, rng = (high + low + close) / 3, high - low
    return {"pivot": p, "r1": 2 * p - low, "s1": 2 * p - high, "r2": p + rng, "s2": p - rng, "r3": high + 2 * (p - low), "s3": low - 2 * (high - p)}


def rolling_quantile(column: str, n: int, q: float, least: int) -> Column:
    """Exact ``q`` quantile (linear) of the ``n`` values before the current bar, once ``least`` are known."""
    window = trailing(n, 1)
    return F.when(F.count(column).over(window) >= least, F.percentile(column, F.lit(q)).over(window))


def state(a: Column, b: Column) -> Column:
    """1 where a > b, -1 where a < b, 0 where equal or unknown."""
    return F.coalesce((a > b).cast("int"), F.lit(0)) - F.coalesce((a < b).cast("int"), F.lit(0))


def zone(x: Column, low: float, high: float) -> Column:
    return F.coalesce((x < low).cast("int"), F.lit(0)) - F.coalesce((x > high).cast("int"), F.lit(0))


def cross(a: str, b: str | float) -> Column:
    """1 on the bar where a passes above b, -1 where it passes below."""
    w = series_window()
    now, then = F.col(a), F.lag(a).over(w)
    level = F.col(b) if isinstance(b, str) else F.lit(b)
    before = F.lag(b).over(w) if isinstance(b, str) else F.lit(b)
    up = F.coalesce(((now > level) & (then <= before)).cast("int"), F.lit(0))
    return up - F.coalesce(((now < level) & (then >= before)).cast("int"), F.lit(0))
