"""Problem 2: implausible readings, by a hidden Markov model per source.

The chain decides: normal and spiking distances overlap, and their densities are estimated for each source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.functions.times import micros
from quillon.operators.batches import bounds, changes, in_order, whole_groups, with_halo
from quillon.sources.tables import SERIES, lengths, plain_pair

NORMAL, SPIKE, STUCK, IMPOSSIBLE = range(4)
PRICES = ["open", "high", "low", "close"]


@dataclass(frozen=True)
class Emissions:
    """Parameters of the model. Distances are in units of the source's median move from bar to bar.

    The densities of normal and of spiking distances overlap: a reading in between is a spike or not by what the chain
    says of its neighbours. ``normal_scale`` and ``to_spike`` are where the estimates of each source start from.
    """

    reach: int = 7  # bars on either side whose medians give the level
    nearest: float = 1.0  # spikes lie anywhere from here to widest, evenly in the logarithm
    widest: float = 1e7
    normal_scale: float = 2.2  # decay of the density of normal distances
    scales: tuple[float, float] = (2.0, 3.0)  # what a source's scale may be
    quiet_repeat: float = 0.03  # chance that a normal bar repeats all four prices of the bar before
    stuck_repeat: float = 0.99
    to_spike: float = 1e-3
    shares: tuple[float, float] = (2e-4, 4e-3)  # what a source's share of spikes may be
    to_stuck: float = 1e-5
    from_spike: float = 0.9
    from_stuck: float = 0.1
    at_least: float = 0.5  # posterior probability from which a reading is flagged
    rounds: int = 8  # of expectation and maximisation over a source's histogram
    weight: float = 2000.0  # bars that the starting values count for


def transitions(e: Emissions, to_spike: np.ndarray) -> np.ndarray:
    """One matrix a group: ``to_spike`` is the source's own."""
    one, n = np.ones_like(to_spike), len(to_spike)
    rows = [
        [1 - 2 * to_spike - e.to_stuck, to_spike, one * e.to_stuck, to_spike],
        [one * e.from_spike * (1 - e.to_stuck), one * (1 - e.from_spike), one * e.from_spike * e.to_stuck, one * 1e-6],
        [one * e.from_stuck, one * 1e-6, one * (1 - e.from_stuck), one * 1e-6],
        [one * 0.5, one * 1e-3, one * e.to_stuck, one * 0.499],
    ]
    return np.stack([np.stack(r, axis=-1) for r in rows], axis=1).reshape(n, 4, 4)


# --- what is normal for a source: histograms of its moves and distances ----------------------------------------------

LOW, STEP, CELLS = -25.0, 1 / 12, 480  # cells of the natural logarithm, from e**-25 to e**15


def cells(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(((np.log(x) - LOW) / STEP).astype(np.int64), 0, CELLS - 1)


def block_sums(batches: Iterator[pa.RecordBatch], e: Emissions) -> Iterator[pa.RecordBatch]:
    """Per block: histograms of its own bars' moves and distances (in logarithms of prices) and their number."""
    for table, group in whole_groups(batches, [*SERIES, "block"]):
        m = measured(table.append_column("_g", pa.array(group)), group, e)
        own = table.column("own").to_numpy(zero_copy_only=False)
        n = int(group[-1]) + 1
        sums = []
        for x, of, mine in ((m.move, m.of, own[m.lead]), (m.beyond, m.of[m.bar], own)):
            good = mine & (x > 0)
            sums.append(np.bincount(of[good] * CELLS + cells(x[good]), minlength=n * CELLS).reshape(n, CELLS))
        at_rest = np.bincount(m.of[m.bar][own & ~(m.beyond > 0)], minlength=n)
        out = table.select([*SERIES, "block"]).take(pa.array(bounds(group)[0]))
        for name, x in zip(("moves", "far"), sums):
            out = out.append_column(name, pa.array(x.astype(np.int32).tolist(), pa.list_(pa.int32())))
        yield from out.append_column("at_rest", pa.array(at_rest)).to_batches()


def estimate(moves: np.ndarray, far: np.ndarray, at_rest: np.ndarray, e: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unit, scale and share of spikes of each source (a row of the histograms each), NaN without a move.

    The unit is the median move. Scale and share are of the mixture of an exponential density of normal distances and
    the even density of spikes, by a few rounds over the histogram; the starting values count for ``weight`` bars.
    """
    total = moves.sum(axis=1)
    middle_cell = np.argmax(np.cumsum(moves, axis=1) * 2 >= np.maximum(total, 1)[:, None], axis=1)
    before = np.take_along_axis(np.cumsum(moves, axis=1) - moves, middle_cell[:, None], axis=1)[:, 0]
    inside = np.take_along_axis(moves, middle_cell[:, None], axis=1)[:, 0]
    unit = np.where(total > 0, np.exp(LOW + STEP * (middle_cell + (total / 2 - before) / np.maximum(inside, 1))), np.nan)
    with np.errstate(invalid="ignore"):
        d = np.clip(np.exp(LOW + STEP * (np.arange(CELLS) + 0.5))[None, :] / unit[:, None], 1e-9, e.widest)
    scale, share = np.full(len(moves), e.normal_scale), np.full(len(moves), e.to_spike)
    spread = np.log(e.widest / e.nearest)
    for _ in range(e.rounds):
        normal = (1 - share)[:, None] * np.exp(-np.minimum(d / scale[:, None], 600.0)) / scale[:, None]
        spike = share[:, None] * np.where(d >= e.nearest, 1 / (d * spread), 0.0)
        chance = np.nan_to_num(spike / np.maximum(normal + spike, 1e-300))
        spikes, calm = (far * chance).sum(axis=1), (far * (1 - chance)).sum(axis=1)
        # half of the bars lie between their levels: beyond is what an exponential density of the rest leaves
        size = np.nansum(far * (1 - chance) * np.nan_to_num(d), axis=1)
        scale = np.clip((size + e.weight * e.normal_scale) / (calm + e.weight), *e.scales)
        share = np.clip((spikes + e.weight * e.to_spike) / (spikes + calm + at_rest + e.weight), *e.shares)
    return unit, scale, share


def source_rows(batches: Iterator[pa.RecordBatch], e: Emissions) -> Iterator[pa.RecordBatch]:
    """unit, scale and share for every block of a source, once its last block's histograms are added; a source is held
    as its running sums and the numbers of its blocks."""
    held, blocks, sums = None, [], None

    def done() -> pa.RecordBatch:
        moves, far, rest = sums
        unit, scale, share = estimate(moves[None, :], far[None, :], np.array([rest]), e)
        n = len(blocks)
        columns = {k: pa.array([v] * n, pa.string()) for k, v in zip(SERIES, held)}
        columns |= {"block": pa.array(blocks, pa.int64()), "unit": pa.array(np.repeat(unit, n), from_pandas=True), "scale": pa.array(np.repeat(scale, n)), "share": pa.array(np.repeat(share, n))}
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in SERIES)))
        moves, far = (batch.column(c).flatten().to_numpy().reshape(-1, CELLS) for c in ("moves", "far"))
        rest, numbers = batch.column("at_rest").to_numpy(), batch.column("block").to_pylist()
        for i, key in enumerate(keys):
            if key != held:
                if blocks:
                    yield done()
                held, blocks, sums = key, [], [np.zeros(CELLS), np.zeros(CELLS), 0]
            blocks.append(numbers[i])
            sums = [sums[0] + moves[i], sums[1] + far[i], sums[2] + int(rest[i])]
    if blocks:
        yield done()


def middle(window: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN where there are only NaNs."""
    window = np.sort(window, axis=1)
    n = (~np.isnan(window)).sum(axis=1)
    rows = np.arange(len(window))
    low, high = window[rows, np.maximum(n - 1, 0) // 2], window[rows, np.minimum(n // 2, window.shape[1] - 1)]
    return np.where(n == 0, np.nan, (low + high) / 2)


def trailing_levels(level: np.ndarray, group: np.ndarray, reach: int) -> np.ndarray:
    """Median level of the ``reach`` bars before each bar, within its group."""
    padded = np.r_[np.full(reach, np.nan), level]
    window = np.lib.stride_tricks.sliding_window_view(padded, reach)[: len(level)].copy()
    first, length = bounds(group)
    place = np.arange(len(level)) - np.repeat(first, length)
    window[np.arange(reach)[None, :] < reach - place[:, None]] = np.nan
    return middle(window)


def forward_backward(emit: np.ndarray, group: np.ndarray, move: np.ndarray) -> np.ndarray:
    """What the other bars of its group say about each bar's state (not its own emission), rows summing to 1.

    ``emit``: (bars, states) likelihoods scaled to a largest value of 1; ``move``: (groups, states, states). All
    groups are run side by side.
    """
    first, length = bounds(group)
    order = np.argsort(-length, kind="stable")
    first, length, move = first[order], length[order], move[order]
    steps, states = int(length.max()), move.shape[1]
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    alive = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")  # groups that have a t-th bar
    start = np.full(states, 1e-3)
    start[NORMAL] = 1 - 1e-3 * (states - 1)
    message = np.tile(start, (len(first), 1))
    for t in range(steps):
        at = first[: alive[t]] + t
        message = message[: alive[t]]
        ahead[at] = message
        message = np.einsum("gi,gij->gj", message * emit[at], move[: alive[t]])
        message /= message.sum(axis=1, keepdims=True)
    last = first + length - 1
    message = np.ones((len(first), states))
    for t in range(steps):  # the t-th bar from the end
        n = alive[t]
        at = last[:n] - t
        behind[at] = message[:n]
        step = np.einsum("gj,gij->gi", message[:n] * emit[at], move[:n])
        message[:n] = step / step.sum(axis=1, keepdims=True)
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True)


@dataclass
class Measured:
    """Versions of bars: what they say by themselves and against the levels around them."""

    price: np.ndarray
    full: np.ndarray  # versions with all four prices
    impossible: np.ndarray
    bar: np.ndarray  # number of each version's bar
    lead: np.ndarray  # first and last version of each bar
    last: np.ndarray
    of: np.ndarray  # group of each bar
    move: np.ndarray  # size of the move to each bar's level, in the logarithm
    beyond: np.ndarray  # how far a version's farthest price lies outside the levels before and after


def measured(block: pa.Table, group: np.ndarray, e: Emissions) -> Measured:
    price = np.column_stack([block.column(c).to_numpy() for c in PRICES]).astype(float)
    known = np.isfinite(price)
    o, h, low, c = price.T
    with np.errstate(invalid="ignore"):
        impossible = ((price <= 0) | np.isinf(price)).any(axis=1) | (h < low) | (o > h) | (o < low) | (c > h) | (c < low)
        logs = np.log(np.where(known & (price > 0), price, np.nan))
    bar = np.cumsum(changes(block, ["_g", "at"])) - 1  # versions of one bar share a number
    lead, versions = bounds(bar)
    of = group[lead]
    last = lead + versions - 1  # the version stored last stands for the bar
    level = middle(logs[last])
    left = trailing_levels(level, of, e.reach)
    right = trailing_levels(level[::-1].copy(), (of.max() - of)[::-1], e.reach)[::-1]
    low_level, high_level = np.fmin(left, right), np.fmax(left, right)
    move = np.abs(np.diff(level, prepend=np.nan))
    move[bounds(of)[0]] = np.nan
    with np.errstate(invalid="ignore"):
        beyond = np.fmax.reduce(np.maximum(np.maximum(logs - high_level[bar][:, None], low_level[bar][:, None] - logs), 0.0), axis=1)
    return Measured(price, known.all(axis=1), impossible, bar, lead, last, of, move, beyond)


def judge(block: pa.Table, group: np.ndarray, e: Emissions) -> dict[str, np.ndarray]:
    """State probabilities of each version of a bar; rows are sorted by group, time and version.

    ``unit``, ``scale`` and ``share`` are the source's; where a source has no name (a null in its key) or no move, they
    are those of the block.
    """
    m = measured(block, group, e)
    first, length = bounds(m.of)
    start = bounds(group)[0]
    unit, scale, share = (block.column(c).to_numpy(zero_copy_only=False).astype(float)[start] for c in ("unit", "scale", "share"))
    for i in np.flatnonzero(np.isnan(unit)):
        seen = m.move[first[i] : first[i] + length[i]]
        seen = seen[seen > 0]
        unit[i] = np.median(seen) if len(seen) else np.nan
    scale, share = np.where(np.isnan(scale), e.normal_scale, scale), np.where(np.isnan(share), e.to_spike, share)
    with np.errstate(invalid="ignore", divide="ignore"):
        distance = np.nan_to_num(m.beyond / unit[m.of][m.bar], nan=0.0, posinf=e.widest)
    repeat = repeats(m, first, length)
    emit = emissions(distance, repeat, m.full, m.impossible, e, scale[m.of][m.bar])
    context = forward_backward(emit[m.last], m.of, transitions(e, share))
    chance = context[m.bar] * emit
    chance /= chance.sum(axis=1, keepdims=True)
    return {"impossible": m.impossible, "distance": distance, "repeat": repeat, "chance": chance}


def repeats(m: Measured, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Versions that have the same four prices as a complete version of the bar before."""
    complete = np.zeros(len(m.lead), dtype=bool)
    complete[m.bar[m.full]] = True
    marks = np.where(complete, np.arange(len(m.lead)), -1)
    carried = np.maximum.accumulate(np.r_[-1, marks[:-1]])
    previous = np.where(carried >= np.repeat(first, length), carried, -1)
    digest = pd.util.hash_array(m.price[:, 0])
    for k in (1, 2, 3):
        digest = digest * np.uint64(0x9E3779B97F4A7C15) + pd.util.hash_array(m.price[:, k])
    place = lambda at: digest + pd.util.hash_array(at)
    return np.isin(place(previous[m.bar]), place(m.bar)[m.full]) & m.full & (previous[m.bar] >= 0)


def emissions(distance: np.ndarray, repeat: np.ndarray, full: np.ndarray, impossible: np.ndarray, e: Emissions, scale: np.ndarray) -> np.ndarray:
    """Likelihood of each reading in the four states, the largest of a row scaled to 1."""
    far = np.minimum(np.maximum(distance, 0.0), e.widest)
    log = np.full((len(distance), 4), -700.0)
    repeats = np.where(full, np.where(repeat, e.quiet_repeat, 1 - e.quiet_repeat), 1.0)
    sticks = np.where(full, np.where(repeat, e.stuck_repeat, 1 - e.stuck_repeat), 1.0)
    calm = -np.minimum(far / scale, 600.0) - np.log(scale)
    log[:, NORMAL] = calm + np.log(repeats)
    log[:, STUCK] = calm + np.log(sticks)
    spike = far >= e.nearest
    log[spike, SPIKE] = -np.log(far[spike]) - np.log(np.log(e.widest / e.nearest)) + np.log(repeats[spike])
    log[impossible, :] = -700.0
    log[impossible, IMPOSSIBLE] = 0.0
    return np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -600.0))


def states(batches: Iterator[pa.RecordBatch], e: Emissions) -> Iterator[pa.RecordBatch]:
    keys = [*SERIES, "block"]
    for table, group in whole_groups(batches, keys):
        found = judge(table.append_column("_g", pa.array(group)), group, e)
        chance = found["chance"]
        state = np.where(found["impossible"], IMPOSSIBLE, np.where(chance[:, SPIKE] >= e.at_least, SPIKE, np.where((chance[:, STUCK] >= e.at_least) & found["repeat"], STUCK, NORMAL)))
        keep = table.column("own").to_numpy(zero_copy_only=False)
        out = table.select([*SERIES, "at", *PRICES]).append_column("state", pa.array(state.astype(np.int32)))
        for name, k in (("p_spike", SPIKE), ("p_stuck", STUCK)):
            out = out.append_column(name, pa.array(chance[:, k]))
        yield from out.append_column("distance", pa.array(found["distance"])).filter(pa.array(keep)).to_batches()


def bar_states(prices: DataFrame, timeframes: DataFrame, e: Emissions = Emissions(), block_bars: int = 4096, halo_bars: int = 512) -> DataFrame:
    """State of each distinct version of a bar: root, pair, tf, at (us), the four prices, ``state`` and more.

    ``state`` is 0 normal, 1 spike, 2 stuck, 3 impossible; ``p_spike`` and ``p_stuck`` are the probabilities
    of the forward-backward pass, ``distance`` how far the farthest price lies outside the levels before and
    after the bar, in median moves of the series.

    Model: each bar of a series is normal, a spike, stuck or out of range. A lasting move agrees with the level
    after it, a lively series has a large median move, so neither is a spike; a stuck bar repeats all four
    prices of the bar before, which quiet trading does a few times at most. Not positive or contradicting
    prices are a hard bound. The chain runs over the bars, of which the version stored last stands for the bar;
    each version is then judged by its own prices and by what the chain says of its place. Median move, scale of the
    normal distances and share of spikes are the series' own: blocks give histograms, which are added up by series,
    and the estimates come back to the blocks by a join on (series, block), for which the blocks already lie right.

    Scale: identical copies of a version collapse before the shuffle. A series is cut into blocks of
    ``block_bars`` bar lengths with ``halo_bars`` more on either side (chains and medians forget much sooner;
    a stuck run keeps its first bar within the halo), so a hot series is spread and a task holds blocks only.

    Null prices are no evidence; rows with a null ``bar_time`` are judged by the hard bound alone (see
    ``judged``); unknown timeframes count bars of a day; empty tables give an empty result.
    """
    versions = versioned(prices).where(F.col("at").isNotNull()).groupBy(*SERIES, "at", *PRICES).agg(F.max("stored").alias("stored"))
    day = F.lit(86_400_000_000)
    length = F.coalesce(F.nullif("length", F.lit(0)), day)
    versions = versions.join(lengths(timeframes), "tf", "left")
    blocks = with_halo(versions, F.col("at"), length * block_bars, length * halo_bars)
    keys = [*SERIES, "block"]
    order = ["at", "stored", *PRICES]
    placed = blocks.select(*keys, *order, "own").repartition(*keys)
    named = "root string, pair string, tf string, block bigint"
    sums = placed.sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: block_sums(batches, e), f"{named}, moves array<int>, far array<int>, at_rest bigint")
    own = in_order(sums, SERIES, "block").mapInArrow(lambda batches: source_rows(batches, e), f"{named}, unit double, scale double, share double")
    # one row a block: hashed where the block's rows lie already, so the rows aren't shuffled again
    known = placed.join(own.hint("shuffle_hash"), keys, "left").select(*placed.columns, "unit", "scale", "share").sortWithinPartitions(*keys, *order)
    schema = "root string, pair string, tf string, at bigint, open double, high double, low double, close double, state int, p_spike double, p_stuck double, distance double"
    return known.mapInArrow(lambda batches: states(batches, e), schema)


def versioned(prices: DataFrame) -> DataFrame:
    return prices.select("line_id", "root", plain_pair(F.col("pair")).alias("pair"), "tf", micros(F.col("bar_time")).alias("at"), *PRICES, micros(F.col("fetched_at")).alias("stored"))


def judged(prices: DataFrame, timeframes: DataFrame, e: Emissions = Emissions()) -> DataFrame:
    """Every implausible row of ``prices``: line_id, state, p_spike, p_stuck, distance.

    The flagged versions (few) are joined back to the rows by two independent 64-bit hashes of series, time and
    prices; only these and the id are shuffled, and adaptive execution splits a version stored very often.
    """
    flagged = bar_states(prices, timeframes, e).where(F.col("state") > 0).select(*mark(), "state", "p_spike", "p_stuck", "distance")
    timed = prices.where(F.col("bar_time").isNotNull())
    found = versioned(timed).select("line_id", *mark()).join(flagged, ["mark_a", "mark_b"]).drop("mark_a", "mark_b")
    o, h, l, c = (F.col(x) for x in PRICES)
    bad = (F.least(o, h, l, c) <= 0) | (h < l) | (o > h) | (o < l) | (c > h) | (c < l)
    untimed = prices.where(F.col("bar_time").isNull() & bad)
    alone = untimed.select("line_id", F.lit(IMPOSSIBLE).alias("state"), F.lit(0.0).alias("p_spike"), F.lit(0.0).alias("p_stuck"), F.lit(0.0).alias("distance"))
    return found.unionByName(alone)


def mark() -> list:
    cols = [*SERIES, "at", *PRICES]
    empty = [F.col(c).isNull() for c in cols]
    return [F.xxhash64(F.lit(1), *cols, *empty).alias("mark_a"), F.xxhash64(F.lit("second"), *reversed(cols), *empty).alias("mark_b")]
