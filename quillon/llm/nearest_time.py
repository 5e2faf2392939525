"""Problem 4: records of two tables paired by nearest time, with x-fast tries over timestamp bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.times import floor_div, micros
from quillon.operators.batches import bounds, in_order, whole_groups
from quillon.sources.tables import SERIES, few, plain_pair

BITS = 41
BLOCK_US = 1 << (BITS - 1)  # about 13 days; with the tolerance on either side a block's times have BITS bits

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class NodeTable:
    """Hash table from (level, prefix) to a trie node: open addressing, filled and asked for in bulk."""

    def __init__(self, level: np.ndarray, prefix: np.ndarray):
        n = len(prefix)
        self.mask = np.int64((1 << max(4, int(2 * n - 1).bit_length())) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, dtype=np.int64)
        self.level, self.prefix = level, prefix
        waiting, at = np.arange(n), self._home(level, prefix)
        while len(waiting):
            free = self.slot[at] < 0
            self.slot[at[free]] = waiting[free]  # of several for one slot the last stays
            lost = self.slot[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & self.mask

    def _home(self, level: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        mixed = (prefix.astype(np.uint64) + level.astype(np.uint64) * _B) * _A
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * _B) >> np.uint64(20)).astype(np.int64) & self.mask

    def find(self, level: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Index of each node, -1 where there is none."""
        out = np.full(len(prefix), -1, dtype=np.int64)
        open_, at = np.arange(len(prefix)), self._home(level, prefix)
        while len(open_):
            node = self.slot[at]
            met = (node >= 0) & (self.level[node] == level[open_]) & (self.prefix[node] == prefix[open_])
            out[open_[met]] = node[met]
            on = (node >= 0) & ~met
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out


class Tries:
    """X-fast tries of many entities: the prefixes of all their keys by length, each with its first and last leaf.

    ``entity`` and ``key`` are sorted; keys have BITS bits. A node of level l holds l leading bits, and the
    entity's number stands in front of them, so one table serves all entities.
    """

    def __init__(self, entity: np.ndarray, key: np.ndarray):
        whole = (entity.astype(np.int64) << BITS) | key
        levels, prefixes, first, last = [], [], [], []
        for level in range(BITS + 1):
            prefix = whole >> (BITS - level)
            start, length = bounds(prefix)
            levels.append(np.full(len(start), level, dtype=np.int64))
            prefixes.append(prefix[start])
            first.append(start)
            last.append(start + length - 1)
        self.nodes = NodeTable(np.concatenate(levels), np.concatenate(prefixes))
        self.first, self.last = np.concatenate(first), np.concatenate(last)
        self.entity, self.key = entity, key

    def around(self, entity: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves before (or at) and after each query in its entity, -1 where there is none."""
        whole = (entity.astype(np.int64) << BITS) | key
        low = np.zeros(len(key), dtype=np.int64)  # longest prefix known to be in the trie
        high = np.full(len(key), BITS, dtype=np.int64)
        node = self.nodes.find(low, whole >> BITS)
        there = node >= 0  # entities without keys have no root
        while (turn := np.flatnonzero(there & (low < high))).size:
            mid = (low[turn] + high[turn] + 1) // 2
            found = self.nodes.find(mid, whole[turn] >> (BITS - mid))
            hit = found >= 0
            low[turn[hit]], node[turn[hit]] = mid[hit], found[hit]
            high[turn[~hit]] = mid[~hit] - 1
        before, after = np.full(len(key), -1, dtype=np.int64), np.full(len(key), -1, dtype=np.int64)
        exact = there & (low == BITS)
        bit = (whole >> np.maximum(BITS - low - 1, 0)) & 1
        right = there & ~exact & (bit == 1)  # the trie goes on to the left only: all its leaves are smaller
        left = there & ~exact & (bit == 0)
        before[exact | right] = self.last[node[exact | right]]
        after[left] = self.first[node[left]]
        after[exact | right] = before[exact | right] + 1
        before[left] = after[left] - 1
        n = len(self.key)
        after[(after >= n) | (self.entity[np.clip(after, 0, n - 1)] != entity)] = -1
        before[(before < 0) | (self.entity[np.clip(before, 0, n - 1)] != entity)] = -1
        return before, after


def pair_block(table: pa.Table, group: np.ndarray) -> pa.Table | None:
    """Nearest key of each query row; ``id`` is null in query rows."""
    time, tolerance = table.column("at").to_numpy(), table.column("tolerance").to_numpy()
    key = time - table.column("block").to_numpy() * BLOCK_US + tolerance
    ident = table.column("id")
    asks = ident.is_null().to_numpy()
    wanted = np.zeros(int(group[-1]) + 1, dtype=bool)
    wanted[group[asks]] = True
    leaf = ~asks & wanted[group]  # entities that nobody asks for need no trie
    asks &= np.isin(group, group[leaf])
    if not asks.any():
        return None
    ids = ident.fill_null(0).to_numpy()
    tries = Tries(group[leaf], key[leaf])
    before, after = tries.around(group[asks], key[asks])
    at, most = time[asks], tolerance[asks]
    leaf_time, leaf_id = time[leaf], ids[leaf]
    far = np.int64(2**62)
    back = np.where(before >= 0, at - leaf_time[before], far)
    ahead = np.where(after >= 0, leaf_time[after] - at, far)
    best = np.where(back <= ahead, before, after)  # the earlier one at equal distance
    near = np.minimum(back, ahead) <= most
    chosen = table.filter(pa.array(asks)).filter(pa.array(near)).select([*SERIES, "at"])
    return chosen.append_column("id", pa.array(leaf_id[best[near]])).append_column("distance", pa.array(np.minimum(back, ahead)[near]))


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, group in whole_groups(batches, [*SERIES, "block"]):
        found = pair_block(table, group)
        if found is not None:
            yield from found.to_batches()


def nearest_time(keys: DataFrame, asks: DataFrame, tolerance: Column) -> DataFrame:
    """For each distinct instant asked for, the nearest key of the same series within ``tolerance`` (us).

    ``keys``: root, pair, tf, ``at`` (us), ``id`` (bigint); of keys at one instant the smallest id counts.
    ``asks``: root, pair, tf, ``at``. ``tolerance`` is a column over ``tf``, null where nothing is paired, below
    a quarter of a block. Out: root, pair, tf, ``at`` of the ask, ``id``, ``distance``. A distance equal to the
    tolerance counts; at equal distance the earlier key is chosen; an equal time is at distance 0.

    Copies of keys and asks collapse before the shuffle. Series are cut into blocks of time; keys within the
    tolerance of a block's border are in the next block too, so each ask meets every key that it may be paired
    with in its own block, and a hot series is many blocks. In a block each series has an x-fast trie: a hash
    table of all prefixes of its timestamps' bits. A binary search over the prefix length finds the longest
    prefix of the asked time, whose node gives predecessor and successor.

    Null series, instants or ids are not paired; empty tables give an empty result; other columns are dropped.
    """
    reach = tolerance.cast("long")
    keyed = keys.where(F.col("at").isNotNull() & F.col("id").isNotNull() & (reach > 0)).groupBy(*SERIES, "at").agg(F.min("id").alias("id"))
    block = floor_div(F.col("at"), BLOCK_US)
    spots = F.array_distinct(F.array(block, floor_div(F.col("at") - reach, BLOCK_US), floor_div(F.col("at") + reach, BLOCK_US)))
    placed = keyed.select(*SERIES, "at", "id", reach.alias("tolerance"), F.explode(spots).alias("block"))
    asked = asks.where(F.col("at").isNotNull() & (reach > 0)).select(*SERIES, "at").distinct()
    asked = asked.select(*SERIES, "at", F.lit(None).cast("long").alias("id"), reach.alias("tolerance"), block.alias("block"))
    sorted_rows = in_order(placed.unionByName(asked), [*SERIES, "block"], "at")
    return sorted_rows.mapInArrow(search, "root string, pair string, tf string, at bigint, id bigint, distance bigint")


def quotes_at_bars(quotes: DataFrame, prices: DataFrame, timeframes: DataFrame) -> DataFrame:
    """quote_id, line_id and distance (us) for each quote with a bar near enough; repeats get the same bar."""
    minutes = {r["tf"]: r["minutes"] for r in few(timeframes.select("tf", "minutes")) if r["minutes"]}
    tolerance = F.lit(None).cast("long")
    for tf, m in minutes.items():
        tolerance = F.when(F.col("tf") == tf, F.lit(m * 60_000_000)).otherwise(tolerance)
    bars = prices.where(F.col("close").isNotNull() & F.col("tf").isin(list(minutes)))
    bars = bars.select("root", plain_pair(F.col("pair")).alias("pair"), "tf", micros(F.col("bar_time")).alias("at"), F.col("line_id").alias("id"))
    asks = quotes.where(F.col("quote_time").isNotNull()).select("quote_id", "root", plain_pair(F.col("pair")).alias("pair"), "tf", micros(F.col("quote_time")).alias("at"))
    nearest = nearest_time(bars, asks, tolerance)
    return asks.join(nearest, [*SERIES, "at"]).select("quote_id", F.col("id").alias("line_id"), "distance")
