"""Exponential recursions (EMA, Wilder), exact and without a task that walks a whole series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from quillon.functions.times import floor_div, micros
from quillon.operators.batches import bounds, in_order, whole_groups
from quillon.operators.bars import series_window
from quillon.operators.windows import true_range
from quillon.sources.tables import SERIES

BLOCK_BARS = 256


def exponential(df: DataFrame, specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Adds the exponential averages ``{name: (column, alpha, least)}``, seeded with the first known value.

    Each is null until ``least`` values are known and where the value itself is unknown; unknown values are
    passed over. ``df`` has root, pair, tf and bar_time.

    A series is cut into blocks of some hundred bars that lie in any task. A first pass gives each block's end as if
    nothing came before it, its first value and its number of values: one row a block. A scan over these rows, in order
    and holding one of them, gives what comes into each block, and a second pass over the same placed rows starts
    there. The rows are shuffled and scanned once, and no series gathers anywhere.
    """
    minutes = F.when(F.col("tf") == "15m", 15).when(F.col("tf") == "1h", 60).otherwise(1440)
    block = floor_div(micros(F.col("bar_time")), F.lit(60_000_000).cast("long") * minutes * BLOCK_BARS)
    keys, names, columns = [*SERIES, "_block"], list(specs), df.columns
    alpha, least = np.array([a for _, a, _ in specs.values()]), np.array([n for _, _, n in specs.values()])

    def known(table: pa.Table) -> np.ndarray:
        return np.vstack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c, _, _ in specs.values()])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            first, _ = bounds(group)
            values = known(table)
            there = ~np.isnan(values)
            count = np.add.reduceat(there, first, axis=1)
            ahead = np.cumsum(there, axis=1)
            left = (ahead[:, np.r_[first[1:], len(group)] - 1])[:, group] - ahead  # known values after each in its block
            weight = alpha[:, None] * (1 - alpha[:, None]) ** left
            end = np.add.reduceat(np.where(there, values * weight, 0.0), first, axis=1)
            place = np.where(there, np.arange(len(group)), len(group))
            lead = np.minimum.reduceat(place, first, axis=1)
            seed = np.where(count > 0, np.take_along_axis(np.c_[values, np.full(len(values), np.nan)], lead, axis=1), np.nan)
            out = table.select(keys).take(pa.array(first))
            for i in range(len(names)):
                for kind, x in (("n", count[i].astype(np.int64)), ("e", end[i]), ("s", seed[i])):
                    out = out.append_column(f"{kind}{i}", pa.array(x, from_pandas=True))
            yield from out.to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carry, seen = None, [None] * len(names), [0] * len(names)
        for batch in batches:
            series = list(zip(*(batch.column(k).to_pylist() for k in SERIES)))
            n, e, s = ([batch.column(f"{kind}{i}").to_pylist() for i in range(len(names))] for kind in "nes")
            carries, counts = [[] for _ in names], [[] for _ in names]
            for r, key in enumerate(series):
                if key != held:
                    held, carry, seen = key, [None] * len(names), [0] * len(names)
                for i, a in enumerate(alpha):
                    carries[i].append(carry[i]), counts[i].append(seen[i])
                    if n[i][r]:
                        begun = s[i][r] if carry[i] is None else carry[i]
                        carry[i] = e[i][r] + (1 - a) ** n[i][r] * begun
                        seen[i] += n[i][r]
            made = [batch.column(k) for k in keys]
            for i in range(len(names)):
                made += [pa.array(carries[i], pa.float64()), pa.array(counts[i], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=[*keys, *(f"{kind}{i}" for i in range(len(names)) for kind in ("_c", "_k"))])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            first, _ = bounds(group)
            into = np.vstack([table.column(f"_c{i}").to_numpy(zero_copy_only=False).astype(float)[first] for i in range(len(names))])
            seen = np.vstack([np.nan_to_num(table.column(f"_k{i}").to_numpy(zero_copy_only=False).astype(float)[first]) for i in range(len(names))]).astype(np.int64)
            found = side_by_side(known(table), group, alpha, least, into, seen)
            out = table.select(columns)
            for i, name in enumerate(names):
                out = out.append_column(name, pa.array(found[i], from_pandas=True))
            yield from out.to_batches()

    placed = df.withColumn("_block", block).repartition(*keys)
    types = dict(df.dtypes)
    key_types = [*(f"{k} {types[k]}" for k in SERIES), "_block bigint"]
    one = placed.sortWithinPartitions(*keys, "bar_time").mapInArrow(ends, ", ".join([*key_types, *(f"n{i} bigint, e{i} double, s{i} double" for i in range(len(names)))]))
    carried = in_order(one, SERIES, "_block").mapInArrow(scan, ", ".join([*key_types, *(f"_c{i} double, _k{i} bigint" for i in range(len(names)))]))
    met = placed.join(carried.hint("shuffle_hash"), keys, "left").select(*df.columns, "_block", *(F.col(f"{kind}{i}") for i in range(len(names)) for kind in ("_c", "_k")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{name}` double" for name in names)])
    return met.sortWithinPartitions(*keys, "bar_time").mapInArrow(values, schema)


def ema(df: DataFrame, name: str, column: str, n: int, least: int | None = None) -> DataFrame:
    return exponential(df, {name: (column, 2 / (n + 1), n if least is None else least)})


def macd(df: DataFrame, short: int = 12, long: int = 26, signal: int = 9) -> DataFrame:
    df = exponential(df, {"_short": ("close", 2 / (short + 1), short), "_long": ("close", 2 / (long + 1), long)})
    df = df.withColumn("macd", F.col("_short") - F.col("_long")).drop("_short", "_long")
    df = exponential(df, {"macd_signal": ("macd", 2 / (signal + 1), signal)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def _gains(df: DataFrame) -> DataFrame:
    move = F.col("close") - F.lag("close").over(series_window())
    return df.withColumns({"_gain": F.when(move > 0, move).when(move.isNotNull(), 0.0), "_loss": F.when(move < 0, -move).when(move.isNotNull(), 0.0)})


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    df = exponential(_gains(df), {"_ag": ("_gain", 1 / n, n), "_al": ("_loss", 1 / n, n)})
    value = F.when(F.col("_ag").isNull(), None).when(F.col("_al") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_ag") / F.nullif("_al", F.lit(0.0))))
    return df.withColumn("rsi", value).drop("_gain", "_loss", "_ag", "_al")


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    return exponential(df.withColumn("_tr", true_range(True)), {"atr": ("_tr", 1 / n, n)}).drop("_tr")


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """adx, plus_di and minus_di by Wilder's averages (alpha 1/n)."""
    w = series_window()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = df.withColumns({
        "_tr": true_range(False), "_pdm": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "_mdm": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
    })
    df = exponential(df, {"_at": ("_tr", 1 / n, n), "_ap": ("_pdm", 1 / n, n), "_am": ("_mdm", 1 / n, n)})
    df = df.withColumns({"plus_di": 100 * F.col("_ap") / F.nullif("_at", F.lit(0.0)), "minus_di": 100 * F.col("_am") / F.nullif("_at", F.lit(0.0))})
    total = F.col("plus_di") + F.col("minus_di")
    df = df.withColumn("_dx", F.when(total > 0, 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / F.nullif(total, F.lit(0.0))))
    return exponential(df, {"adx": ("_dx", 1 / n, n)}).drop("_tr", "_pdm", "_mdm", "_at", "_ap", "_am", "_dx")


def side_by_side(values: np.ndarray, group: np.ndarray, alpha: np.ndarray, least: np.ndarray, into: np.ndarray | None = None, before: np.ndarray | None = None) -> np.ndarray:
    """Exponential averages of several columns (rows of ``values``) for all groups at once, NaN where not known.

    ``into`` and ``before`` are each group's average and number of known values so far, a column a group.
    """
    first, length = bounds(group)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, int(length.max()) + 1), side="right")
    out = np.full(values.shape, np.nan)
    a = alpha[:, None]
    state = np.full((len(alpha), len(first)), np.nan) if into is None else into[:, order].copy()
    seen = np.zeros((len(alpha), len(first)), dtype=np.int64) if before is None else before[:, order].copy()
    for t, k in enumerate(alive):
        state, seen = state[:, :k], seen[:, :k]
        x = values[:, first[:k] + t]
        known = ~np.isnan(x)
        state = np.where(known, np.where(np.isnan(state), x, a * x + (1 - a) * state), state)
        seen = seen + known
        out[:, first[:k] + t] = np.where(known & (seen >= least[:, None]), state, np.nan)
    return out


def recursions(df: DataFrame, n: int = 14, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """All recursive indicators in one pass: macd, macd_signal, macd_hist, rsi, atr, adx, plus_di, minus_di, psar, psar_trend.

    And cci, whose mean deviation isn't decomposable: here its window is a view and not a list a row.

    For frames that hold the parabolic stop, whose state machine walks a series in one task anyway; where only
    averages are wanted, ``exponential`` spreads a series over blocks. Series run side by side in numpy.
    """
    names = ["macd", "macd_signal", "macd_hist", "rsi", "atr", "adx", "plus_di", "minus_di", "cci"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, SERIES):
            high, low, close = (table.column(c).to_numpy() for c in ("high", "low", "close"))
            before = lambda x: np.where(np.r_[True, group[1:] != group[:-1]], np.nan, np.r_[np.nan, x[:-1]])
            move, up, down, was = close - before(close), high - before(high), before(low) - low, before(close)
            tr = np.maximum(high - low, np.maximum(np.abs(high - was), np.abs(low - was)))
            gone = np.isnan(move)
            mask = lambda x: np.where(gone, np.nan, x)
            with np.errstate(invalid="ignore", divide="ignore"):
                pdm, mdm = mask(np.where((up > down) & (up > 0), up, 0.0)), mask(np.where((down > up) & (down > 0), down, 0.0))
                sums = np.vstack([close, close, mask(np.maximum(move, 0)), mask(np.maximum(-move, 0)), np.where(gone, high - low, tr), mask(tr), pdm, mdm])
                a = 1 / n
                short, long, gain, loss, atr_, at, ap, am = side_by_side(sums, group, np.array([2 / 13, 2 / 27, a, a, a, a, a, a]), np.array([12, 26, n, n, n, n, n, n]))
                line, plus, minus = short - long, 100 * ap / np.where(at > 0, at, np.nan), 100 * am / np.where(at > 0, at, np.nan)
                dx = 100 * np.abs(plus - minus) / np.where(plus + minus > 0, plus + minus, np.nan)
                signal, adx_ = side_by_side(np.vstack([line, dx]), group, np.array([0.2, a]), np.array([9, n]))
                rsi_ = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / np.where(loss == 0, 1.0, loss)))
            stop, trend = stop_and_reverse(high, low, close, group, step, most)
            out = table
            for name, x in zip(names, (line, signal, line - signal, rsi_, atr_, adx_, plus, minus, channel((high + low + close) / 3, group, 20))):
                out = out.append_column(name, pa.array(x, from_pandas=True))
            yield from out.append_column("psar", pa.array(stop, from_pandas=True)).append_column("psar_trend", pa.array(trend)).to_batches()

    rows = in_order(df.select(*SERIES, "bar_time", "open", "high", "low", "close"), SERIES, "bar_time")
    fields = ", ".join(f"{c} double" for c in ("open", "high", "low", "close", *names, "psar"))
    return rows.mapInArrow(run, f"root string, pair string, tf string, bar_time timestamp_ntz, {fields}, psar_trend int")


def channel(typical: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Typical price against its mean of ``n`` bars, in 0.015 mean absolute deviations; NaN before ``n`` bars or without spread."""
    out = np.full(len(typical), np.nan)
    if len(typical) >= n:
        view = sliding_window_view(typical, n)
        mean = view.mean(axis=1)
        spread = np.abs(view - mean[:, None]).mean(axis=1)
        whole = (group[n - 1 :] == group[: len(group) - n + 1]) & (spread > 1e-12)
        out[n - 1 :][whole] = (typical[n - 1 :][whole] - mean[whole]) / (0.015 * spread[whole])
    return out


def stop_and_reverse(high: np.ndarray, low: np.ndarray, close: np.ndarray, group: np.ndarray, step: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Parabolic stop and trend of each bar, all groups side by side: one numpy step per bar of the longest."""
    first, length = bounds(group)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    stop, trend = np.full(len(high), np.nan), np.zeros(len(high), dtype=np.int32)
    alive = np.searchsorted(-length, -np.arange(1, int(length.max()) + 1), side="right")
    n = alive[1] if len(alive) > 1 else 0
    a, b = first[:n], first[:n] + 1
    rising = close[b] >= close[a]
    top, bottom = np.maximum(high[a], high[b]), np.minimum(low[a], low[b])
    s, best, speed = np.where(rising, bottom, top), np.where(rising, top, bottom), np.full(n, step)
    stop[b], trend[b] = s, np.where(rising, 1, -1)
    for t in range(2, len(alive)):
        k = alive[t]
        rising, s, best, speed = rising[:k], s[:k], best[:k], speed[:k]
        now, one, two = first[:k] + t, first[:k] + t - 1, first[:k] + t - 2
        s = s + speed * (best - s)
        s = np.where(rising, np.minimum(s, np.minimum(low[one], low[two])), np.maximum(s, np.maximum(high[one], high[two])))
        broken = np.where(rising, low[now] < s, high[now] > s)
        edge, reach = np.where(rising, high[now], low[now]), np.where(rising, high[now] > best, low[now] < best)
        turned = np.where(rising, np.maximum(best, np.maximum(high[now], high[one])), np.minimum(best, np.minimum(low[now], low[one])))
        speed = np.where(broken, step, np.where(reach, np.minimum(speed + step, most), speed))
        s = np.where(broken, turned, s)
        best = np.where(broken, np.where(rising, low[now], high[now]), np.where(reach, edge, best))
        rising = rising ^ broken
        stop[now], trend[now] = s, np.where(rising, 1, -1)
    return stop, trend


def parabolic(df: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """root, pair, tf, bar_time, psar and psar_trend of each bar.

    A state machine whose state depends on every earlier bar: a series runs in one task, series side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, SERIES):
            stop, trend = stop_and_reverse(*(table.column(c).to_numpy() for c in ("high", "low", "close")), group, step, most)
            out = table.select([*SERIES, "bar_time"]).append_column("psar", pa.array(stop, from_pandas=True)).append_column("psar_trend", pa.array(trend))
            yield from out.to_batches()

    rows = in_order(df.select(*SERIES, "bar_time", "high", "low", "close"), SERIES, "bar_time")
    return rows.mapInArrow(run, "root string, pair string, tf string, bar_time timestamp_ntz, psar double, psar_trend int")
