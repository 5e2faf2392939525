"""The indicator frame, the 25 textbook signals on it and their consensus."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from quillon.operators import recursive as R, windows as V
from quillon.operators.bars import LONDON, in_zone, series_window, trading_day
from quillon.sources.tables import SERIES

CLOUD_SHIFT = 26

# --- rules ----------------------------------------------------------------------------------------------------------
# A rule is a condition to buy and one to sell over the columns of the indicator frame; ``was_x`` is x one bar earlier.
# Conditions on unknown values don't hold. The forms below write them down; names, inputs and limits are fixed values.

Rule = tuple[str, str]


def over(a: str, b: str | float) -> Rule:
    return f"{a} > {b}", f"{a} < {b}"


def through(a: str, b: str | float) -> Rule:
    """a passes b from one bar to the next; b is a column or a level."""
    then = f"was_{b}" if isinstance(b, str) else b
    return f"{a} > {b} AND was_{a} <= {then}", f"{a} < {b} AND was_{a} >= {then}"


def outside(x: str, low: str | float, high: str | float, closed: bool = False) -> Rule:
    """Bought below the low limit and sold above the high one."""
    return (f"{x} <= {low}", f"{x} >= {high}") if closed else (f"{x} < {low}", f"{x} > {high}")


def beyond(x: str, low: str, high: str) -> Rule:
    """Bought above the high limit and sold below the low one."""
    return f"{x} > {high}", f"{x} < {low}"


def both(*rules: Rule) -> Rule:
    return tuple(" AND ".join(f"({r[side]})" for r in rules) for side in (0, 1))


def only(rule: Rule, buy: str, sell: str | None = None) -> Rule:
    return f"({rule[0]}) AND {buy}", f"({rule[1]}) AND {sell or buy}"


CLOUD = beyond("close", "cloud_bottom", "cloud_top")
TOUCH = ("low <= bb_lower", "high >= bb_upper")
RULES: dict[str, Rule] = {
    "sma20": over("close", "sma20"), "sma75": over("close", "sma75"), "sma200": over("close", "sma200"),
    "ma_20_75": over("sma20", "sma75"), "ma_20_75_cross": through("sma20", "sma75"),
    "macd_state": over("macd", "macd_signal"), "macd_cross": through("macd", "macd_signal"), "macd_zero": over("macd", 0),
    "rsi_50_cross": through("rsi", 50), "rsi_30_70": outside("rsi", 30, 70),
    "bb_pctb": outside("pctb", 0, 1, closed=True), "bb_touch": only(TOUCH, f"NOT ({TOUCH[1]})", f"NOT ({TOUCH[0]})"),
    "bb_break": both(beyond("close", "bb_lower", "bb_upper"), ("was_close <= was_bb_upper", "was_close >= was_bb_lower")),
    "ichi_cloud": CLOUD, "ichi_tk": over("tenkan", "kijun"), "ichi_tk_cross": through("tenkan", "kijun"),
    "ichi_sanyaku": both(over("tenkan", "kijun"), CLOUD, over("close", "close_26")),
    "stoch_cross": only(through("stoch_k", "stoch_d"), "stoch_d < 20", "stoch_d > 80"),
    "adx_di": only(over("plus_di", "minus_di"), "adx > 25"), "psar": over("psar_trend", 0),
    "donchian20": beyond("close", "don_low", "don_high"), "pivot": over("close", "pivot_point"), "roc12": over("roc12", 0),
    "williams_r": outside("williams_r", -80, -20), "cci_100": outside("cci", -100, 100),
}
SIGNALS = list(RULES)
PLACES = 9  # digits that values are compared at: of frozen prices a mean and a price are the same


def lagged() -> list[str]:
    """Columns whose value one bar earlier some rule reads."""
    return sorted({w for rule in RULES.values() for text in rule for w in re.findall(r"was_(\w+)", text)})


def compared() -> list[str]:
    """Columns that rules read."""
    words = {w for rule in RULES.values() for text in rule for w in re.findall(r"[a-z]\w*", text)}
    return sorted(w for w in words if not w.startswith("was_"))


def verdict(name: str) -> str:
    buy, sell = RULES[name]
    return f"CASE WHEN {buy} THEN 1 WHEN {sell} THEN -1 ELSE 0 END"


# --- the frame ------------------------------------------------------------------------------------------------------


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    df = df.withColumn("_raw", V.place_in_range(n, 50.0, 100.0, False)).withColumn("stoch_k", V.sma("_raw", smooth))
    return df.withColumn("stoch_d", V.sma("stoch_k", d)).drop("_raw")


def previous_day_pivots(df: DataFrame) -> DataFrame:
    """Pivots of the trading day before each bar's ``day``; the days are aggregated first and joined back."""
    days = df.groupBy(*SERIES, "day").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bar_time").alias("c"))
    order = Window.partitionBy(*SERIES).orderBy("day")
    names = V.pivots(F.col("h"), F.col("l"), F.col("c"))
    before = days.select(*SERIES, "day", *(F.lag(x).over(order).alias(x) for x in "hlc")).select(*SERIES, "day", *(v.alias(k) for k, v in names.items()))
    return df.join(before, [*SERIES, "day"])


def pivots_within(df: DataFrame) -> DataFrame:
    """The same over sorted series, without joining: a day's figures are complete at its last bar."""
    w = series_window()
    so_far = Window.partitionBy(*SERIES, "day").orderBy("bar_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    day = F.struct(F.max("high").over(so_far).alias("h"), F.min("low").over(so_far).alias("l"), F.col("close").alias("c"))
    df = df.withColumn("_day", day)
    start = F.col("day") != F.lag("day").over(w)
    df = df.withColumn("_before", F.when(start, F.lag("_day").over(w)))
    df = df.withColumn("_before", F.last("_before", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return df.withColumns(V.pivots(F.col("_before.h"), F.col("_before.l"), F.col("_before.c"))).drop("_day", "_before")


def indicator_frame(bars: DataFrame) -> DataFrame:
    """Every indicator that the signals read, at each bar from that bar and earlier ones.

    All recursions run in one pass over the sorted series; all trailing windows then share one sort. The pivots are those of the day before the bar's London trading day, or of the daily bar before.
    """
    df = R.recursions(bars)
    local = F.when(F.col("tf") == "1d", F.col("bar_time")).otherwise(in_zone(F.col("bar_time"), LONDON))
    df = df.withColumn("day", F.when(F.col("tf") == "1d", F.to_date("bar_time")).otherwise(trading_day(local)))
    df = df.withColumns({**{f"sma{n}": V.sma("close", n) for n in (20, 75, 200)}, **V.bollinger("close"), **V.ichimoku(), **V.donchian(), "williams_r": V.williams_r(), "roc12": V.roc(12)})
    df = pivots_within(stochastic(df)).drop("day").withColumnRenamed("pivot", "pivot_point")
    w = series_window()
    a, b = F.lag("span_a", CLOUD_SHIFT).over(w), F.lag("span_b", CLOUD_SHIFT).over(w)
    known = a.isNotNull() & b.isNotNull()
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({
        "cloud_top": F.when(known, F.greatest(a, b)), "cloud_bottom": F.when(known, F.least(a, b)), "close_26": F.lag("close", CLOUD_SHIFT).over(w),
        "pctb": F.when(width > 0, (F.col("close") - F.col("bb_lower")) / F.nullif(width, F.lit(0.0))),
    }).drop("span_a", "span_b")


def signal_frame(bars: DataFrame) -> DataFrame:
    """The signals (1 buy, -1 sell, 0 none or unknown) at each bar, compiled from RULES."""
    w = series_window()
    df = indicator_frame(bars)
    whole = dict(df.dtypes)
    df = df.withColumns({c: F.round(c, PLACES) for c in compared() if whole[c] == "double"})
    df = df.withColumns({f"was_{c}": F.lag(c).over(w) for c in lagged()})
    return df.select(*SERIES, "bar_time", *(F.expr(verdict(name)).alias(name) for name in RULES))


# fixed values: sizes of the score from which a level counts; the first must be exceeded, the second reached
LEVELS = (0.1 + 1e-9, 0.4 - 1e-9)


def consensus(signals: DataFrame, keys: list[str] = SIGNALS, cuts: tuple[float, ...] = LEVELS) -> DataFrame:
    """``score``, the mean of the signals, and ``level``: its sign times the number of cuts that its size is beyond."""
    mean = F.aggregate(F.array(*keys), F.lit(0), lambda total, x: total + x) / len(keys)
    scored = signals.select(*SERIES, "bar_time", mean.alias("score"))
    passed = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.abs("score") > cut))
    return scored.withColumn("level", (F.signum("score") * passed).cast("int"))
