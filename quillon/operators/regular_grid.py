"""Problem 5: irregular readings onto a regular grid, by a Kalman smoother with a continuous-time local trend."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.times import floor_div, micros
from quillon.operators.batches import bounds, in_order, whole_groups, with_halo
from quillon.sources.tables import SERIES, plain_pair, small


@dataclass(frozen=True)
class Trend:
    """Noise of the model relative to a series' own moves; times are in slots."""

    reading: float = 0.05  # variance of a reading, in units of the variance of a move over one slot
    slope: float = 1e-4  # variance gained by the slope in one slot, same units
    start: float = 1e4


def smooth(at: np.ndarray, value: np.ndarray, group: np.ndarray, p: Trend, unit: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Smoothed level and slope at each reading, and the filter's states, all groups side by side.

    ``unit`` is the variance of a move over one slot at each reading, one for a group; else the group's own is used.

    State (level, slope) with level' = slope + white noise and slope' = white noise, in continuous time: over a
    step d the covariance grows by q*d + s*d**3/3, s*d**2/2 and s*d.
    """
    first, length = bounds(group)
    n = len(at)
    gap = np.diff(at, prepend=at[:1])
    gap[first] = 0
    unit = own_units(gap, value, first, length) if unit is None else unit[first]
    order = np.argsort(-length, kind="stable")
    first_o, length_o, q = first[order], length[order], unit[order]
    alive = np.searchsorted(-length_o, -np.arange(1, int(length_o.max()) + 1), side="right")
    r, s = p.reading * q, p.slope * q
    keep = {k: np.zeros(n) for k in ("level", "slope", "p11", "p12", "p22", "b11", "b12", "b22", "bl", "bs")}
    level, slope = value[first_o].copy(), np.zeros(len(q))
    p11, p12, p22 = p.start * q, np.zeros(len(q)), q.copy()
    for t, k in enumerate(alive):
        at_t = first_o[:k] + t
        level, slope, p11, p12, p22 = (x[:k] for x in (level, slope, p11, p12, p22))
        d = gap[at_t]
        level = level + slope * d
        p11 = p11 + 2 * d * p12 + d * d * p22 + q[:k] * d + s[:k] * d**3 / 3
        p12 = p12 + d * p22 + s[:k] * d**2 / 2
        p22 = p22 + s[:k] * d
        for name, x in (("bl", level), ("bs", slope), ("b11", p11), ("b12", p12), ("b22", p22)):
            keep[name][at_t] = x
        total = p11 + r[:k]
        g1, g2, miss = p11 / total, p12 / total, value[at_t] - level
        level, slope = level + g1 * miss, slope + g2 * miss
        p11, p12, p22 = p11 * (1 - g1), p12 * (1 - g1), p22 - g2 * p12
        for name, x in (("level", level), ("slope", slope), ("p11", p11), ("p12", p12), ("p22", p22)):
            keep[name][at_t] = x
    out = {k: keep[k].copy() for k in ("level", "slope", "p11", "p12", "p22")}
    for t in range(len(alive) - 1, 0, -1):  # from the end: bar t of a group smooths bar t - 1
        k = alive[t]
        now, then = first_o[:k] + t - 1, first_o[:k] + t
        state = [keep[x][now] for x in ("level", "slope", "p11", "p12", "p22")]
        ahead = [keep[x][then] for x in ("bl", "bs", "b11", "b12", "b22")]
        later = [out[x][then] for x in ("level", "slope", "p11", "p12", "p22")]
        for name, x in zip(("level", "slope", "p11", "p12", "p22"), back_step(state, ahead, later, gap[then])):
            out[name][now] = x
    return out | {f"f_{k}": keep[k] for k in ("level", "slope", "p11", "p12", "p22")} | {k: keep[k] for k in ("bl", "bs", "b11", "b12", "b22")} | {"unit": np.repeat(unit, length), "gap": gap}


def own_units(gap: np.ndarray, value: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    move = np.diff(value, prepend=value[:1])
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.where(gap > 0, move**2 / np.maximum(gap, 0.25), np.nan)
    unit = np.empty(len(first))
    for i, (a, m) in enumerate(zip(first, length)):
        seen = rate[a : a + m]
        seen = seen[np.isfinite(seen) & (seen > 0)]
        unit[i] = np.median(seen) / 0.4549 if len(seen) else max(abs(value[a]) * 1e-4, 1e-9) ** 2  # median of chi-square(1)
    return unit


CELLS = 2048  # cells of the moves' logarithm to a factor of e; a cell is held as a list


def with_units(one: DataFrame) -> DataFrame:
    return one.join(series_units(one), SERIES)


def series_units(one: DataFrame, block_slots: int = 1024) -> DataFrame:
    """``unit`` of each series: what ``own_units`` gives for the whole of it.

    Moves are taken within blocks of time; the first and last readings of the blocks give the moves across. Moves are
    put together by narrow cells of their logarithm, the cells' counts are run up, and the median is picked from its
    cell. No task holds or sorts a series.
    """
    cut = one.withColumn("_b", floor_div(F.col("at"), F.col("slot_us") * block_slots))
    inside = Window.partitionBy(*SERIES, "_b").orderBy("at")
    rate = lambda was_at, was: F.pow(F.col("value") - was, F.lit(2.0)) / F.greatest((F.col("at") - was_at) / F.col("slot_us"), F.lit(0.25))
    told = cut.withColumns({"_t": F.lag("at").over(inside), "_u": F.lag("value").over(inside), "_last": F.lead("at").over(inside).isNull()})
    within = told.where(F.col("_t").isNotNull()).select(*SERIES, "at", "value", rate(F.col("_t"), F.col("_u")).alias("_r"))
    across = Window.partitionBy(*SERIES).orderBy("at")
    border = told.where(F.col("_t").isNull() | F.col("_last")).withColumns({"_wt": F.lag("at").over(across), "_wu": F.lag("value").over(across)})
    border = border.where(F.col("_t").isNull()).select(*SERIES, "at", "value", rate(F.col("_wt"), F.col("_wu")).alias("_r"))
    good = (F.col("_r") > 0) & (F.col("_r") < float("inf"))
    rates = within.unionByName(border).withColumn("_r", F.when(good, F.col("_r")))
    cells = rates.groupBy(*SERIES, F.floor(F.log("_r") * CELLS).alias("_c")).agg(F.sort_array(F.collect_list("_r")).alias("_a"), F.min(F.struct("at", "value")).alias("_f"))
    series = Window.partitionBy(*SERIES)
    n = F.size("_a")
    run = cells.withColumns({"_upto": F.sum(n).over(series.orderBy(F.col("_c").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_all": F.sum(n).over(series)})
    at = lambda place: F.try_element_at("_a", F.when((place >= F.col("_upto") - n) & (place < F.col("_upto")), (place - F.col("_upto") + n + 1).cast("int")))
    ends = run.withColumns({"_x": at(F.floor((F.col("_all") - 1) / 2)), "_y": at(F.ceil((F.col("_all") - 1) / 2))})
    units = ends.groupBy(*SERIES).agg(((F.max("_x") + F.max("_y")) / 2).alias("_m"), F.min("_f")["value"].alias("_v"))
    none = F.pow(F.greatest(F.abs("_v") * 1e-4, F.lit(1e-9)), F.lit(2.0))
    return units.select(*SERIES, F.coalesce(F.col("_m") / 0.4549, none).alias("unit"))


def back_step(state: list, ahead: list, later: list, d: np.ndarray) -> list:
    """Rauch-Tung-Striebel step: filtered ``state``, its prediction ``ahead`` by ``d`` and the smoothed ``later``."""
    l, s, p11, p12, p22 = state
    al, a_s, a11, a12, a22 = ahead
    ll, ls, l11, l12, l22 = later
    c11, c12, c21, c22 = p11 + p12 * d, p12, p12 + p22 * d, p22  # P F'
    det = np.maximum(a11 * a22 - a12 * a12, 1e-300)
    g11, g12 = (c11 * a22 - c12 * a12) / det, (c12 * a11 - c11 * a12) / det
    g21, g22 = (c21 * a22 - c22 * a12) / det, (c22 * a11 - c21 * a12) / det
    e1, e2 = ll - al, ls - a_s
    d11, d12, d22 = l11 - a11, l12 - a12, l22 - a22
    n11 = p11 + g11 * (g11 * d11 + g12 * d12) + g12 * (g11 * d12 + g12 * d22)
    n12 = p12 + g21 * (g11 * d11 + g12 * d12) + g22 * (g11 * d12 + g12 * d22)
    n22 = p22 + g21 * (g21 * d11 + g22 * d12) + g22 * (g21 * d12 + g22 * d22)
    return [l + g11 * e1 + g12 * e2, s + g21 * e1 + g22 * e2, n11, n12, n22]


def at_slots(found: dict, before: np.ndarray, d: np.ndarray, p: Trend) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its standard deviation at ``d`` slots after reading ``before``, in the gap to the next."""
    q, s = found["unit"][before], p.slope * found["unit"][before]
    grow = lambda x11, x12, x22, t: (x11 + 2 * t * x12 + t * t * x22 + q * t + s * t**3 / 3, x12 + t * x22 + s * t**2 / 2, x22 + s * t)
    l, sl = found["f_level"][before], found["f_slope"][before]
    p11, p12, p22 = grow(*(found[f"f_{k}"][before] for k in ("p11", "p12", "p22")), d)
    after = before + 1
    state = [l + sl * d, sl, p11, p12, p22]
    ahead = [found[k][after] for k in ("bl", "bs", "b11", "b12", "b22")]
    later = [found[k][after] for k in ("level", "slope", "p11", "p12", "p22")]
    level, _, n11, _, _ = back_step(state, ahead, later, found["gap"][after] - d)
    return level, np.sqrt(np.maximum(n11, 0.0))


def grid(batches: Iterator[pa.RecordBatch], p: Trend, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    for table, group in whole_groups(batches, [*SERIES, "block"]):
        time, value, role, size, unit = (table.column(c).to_numpy() for c in ("at", "value", "role", "slot_us", "unit"))
        fresh = np.r_[True, (time[1:] != time[:-1]) | (group[1:] != group[:-1])]
        # a reading may be here by the halo and as the neighbour of the block; own rows sort first
        time, value, role, size, unit, group = time[fresh], value[fresh], role[fresh], size[fresh], unit[fresh], group[fresh]
        index = np.flatnonzero(fresh)
        slot = time // size
        found = smooth((time - time[0]) / size, value, group, p, unit)
        same = np.r_[group[1:] == group[:-1], False]
        own = role == 0
        # own readings: one row for the first of a slot; a slot's start lies in the gap before its first reading
        opens = np.r_[True, (slot[1:] != slot[:-1]) | ~same[:-1]]
        mine = np.flatnonzero(own & opens)
        ends = np.append(np.flatnonzero(opens), len(slot))
        n_here = np.diff(ends)[np.searchsorted(ends, mine)]
        start = slot[mine] * size[mine]
        d = (start - time[mine]) / size[mine]
        lone = np.r_[True, ~same[:-1]][mine]  # nothing before: carry the trend back
        prior = np.where(lone, np.minimum(mine, len(slot) - 2) if len(slot) > 1 else 0, mine - 1)
        level = found["level"][mine] + d * found["slope"][mine]
        sd = np.sqrt(np.maximum(found["p11"][mine] + 2 * d * found["p12"][mine] + d * d * found["p22"][mine] - d * found["unit"][mine], 0.0))
        inner = np.flatnonzero(~lone)
        if len(inner):
            level[inner], sd[inner] = at_slots(found, prior[inner], (start[inner] - time[prior[inner]]) / size[mine[inner]], p)
        yield from emit(table, index[mine], slot[mine] * size[mine] // 1_000_000, level, sd, n_here)
        # gaps that end in an own reading belong to this block
        gaps = np.flatnonzero(same & np.r_[own[1:], False])
        count = np.maximum(np.r_[slot[1:] - slot[:-1] - 1, 0][gaps], 0) if len(gaps) else np.zeros(0, dtype=np.int64)
        gaps, count = gaps[count > 0], count[count > 0]
        total = np.cumsum(count)
        for a in range(0, int(total[-1]) if len(total) else 0, rows):  # long gaps come in pieces
            k = np.arange(a, min(a + rows, int(total[-1])))
            which = np.searchsorted(total, k, side="right")
            before = gaps[which]
            step = k - (total[which] - count[which]) + 1
            empty = slot[before] + step
            level, sd = at_slots(found, before, (empty * size[before] - time[before]) / size[before], p)
            yield from emit(table, index[before], empty * size[before] // 1_000_000, level, sd, np.zeros(len(k), dtype=np.int64))


def emit(table: pa.Table, index: np.ndarray, slot: np.ndarray, level: np.ndarray, sd: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = table.select(SERIES).take(pa.array(index))
    more = {"slot": slot.astype(np.int64), "value": level, "sd": sd, "readings": count.astype(np.int64)}
    for name, x in more.items():
        keys = keys.append_column(name, pa.array(x))
    yield from keys.append_column("missing", pa.array(count == 0)).to_batches()


def regular_grid(readings: DataFrame, slot_us: Column, block_slots: int = 1024, halo_slots: int = 96, p: Trend = Trend()) -> DataFrame:
    """A row per series and slot from its first to its last reading: slot, value, sd, readings, missing.

    ``readings``: root, pair, tf, ``at`` (us) and ``value``; ``slot_us`` is the length of a slot as a column of
    it. ``slot`` is the start in epoch seconds, ``value`` and ``sd`` the smoothed level at that start and its
    standard deviation, ``readings`` the number of distinct instants read in the slot and ``missing`` whether
    there was none.

    Readings of one instant are averaged before the shuffle. A series is cut into blocks of ``block_slots``
    slots with a halo of readings on either side; each block also gets the nearest reading before and after it,
    wherever that is, and owns the gap before each of its readings, so gaps of any length are filled once and
    from both ends. Slots inside a gap come in closed form from the smoothed ends: the recursion runs over
    readings only, with the noise level of the whole series. Blocks without readings don't exist, hot series are many blocks.

    Rows with a null series, instant or value are no readings; ties at an instant are averaged; empty tables
    give an empty result; other columns are dropped.
    """
    good = F.col("at").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & slot_us.isNotNull() & (slot_us > 0)
    one = readings.where(good).groupBy(*SERIES, "at", slot_us.cast("long").alias("slot_us")).agg(F.avg("value").alias("value"))
    width = F.col("slot_us") * block_slots
    near = with_halo(one, F.col("at"), width, F.col("slot_us") * halo_slots)
    near = near.select(*SERIES, "block", "slot_us", "at", "value", F.when(F.col("own"), 0).otherwise(1).alias("role"))
    ends = one.groupBy(*SERIES, "slot_us", floor_div(F.col("at"), width).alias("block")).agg(F.min(F.struct("at", "value")).alias("a"), F.max(F.struct("at", "value")).alias("z"))
    order = Window.partitionBy(*SERIES).orderBy("block")
    bridges = ends.select(*SERIES, "slot_us", "block", F.array_compact(F.array(F.lag("z").over(order), F.lead("a").over(order))).alias("both"))
    bridges = bridges.select(*SERIES, "block", "slot_us", F.inline("both")).withColumn("role", F.lit(1))
    whole = near.unionByName(bridges).join(series_units(one), SERIES)
    # a block outside the series' readings (a halo without own readings) has nothing to own
    sorted_rows = in_order(whole, [*SERIES, "block"], "at", "role")
    schema = "root string, pair string, tf string, slot bigint, value double, sd double, readings bigint, missing boolean"
    return sorted_rows.mapInArrow(lambda batches: grid(batches, p), schema)


def quote_grid(quotes: DataFrame, timeframes: DataFrame) -> DataFrame:
    """The live quotes of each root, pair and tf on the slots of the timeframe."""
    minutes = small(timeframes.where(F.col("minutes") > 0).select("tf", (F.col("minutes").cast("long") * 60_000_000).alias("slot_us")))
    read = quotes.select("root", plain_pair(F.col("pair")).alias("pair"), "tf", micros(F.col("quote_time")).alias("at"), F.col("price").alias("value"))
    return regular_grid(read.join(minutes, "tf"), F.col("slot_us"))
