"""Whole groups out of sorted Arrow batches, and time blocks with halos.

Sequential kernels (hidden Markov chain, Kalman smoother, trie search) run in ``mapInArrow`` over partitions
that hold whole groups in order. Many groups are computed together as one padded numpy problem; the Python cost
of a group is a few rows of a matrix, not a call.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions.times import floor_div


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True at each row whose keys differ from the row before; the first row is True."""
    n = table.num_rows
    out = np.zeros(n, dtype=bool)
    if n:
        out[0] = True
    for key in keys if n > 1 else []:
        col = table.column(key).combine_chunks()
        a, b = col.slice(1), col.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        lone = pc.xor(pc.is_null(a), pc.is_null(b))
        out[1:] |= pc.or_(differ, lone).to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 60_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of at least ``rows`` rows (but the last) that end where a group ends, with each row's group number.

    Memory: ``rows`` and the largest group, which the caller bounds by its blocks.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, count
        whole = pa.Table.from_batches(held)
        starts = changes(whole, keys)
        end = whole.num_rows if last else int(np.flatnonzero(starts)[-1])
        rest = whole.slice(end)
        held, count = rest.to_batches(), rest.num_rows
        if end:
            yield whole.slice(0, end), np.cumsum(starts[:end]) - 1

    wanted = rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= wanted:
            yield from cut(False)
            wanted = count + rows
    if held:
        yield from cut(True)


def bounds(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each group in a sorted array of group numbers."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.r_[first, len(group)])


def with_halo(df: DataFrame, at: Column, width: Column, halo: Column) -> DataFrame:
    """Each row in its block of ``width`` (``own`` true) and, within ``halo`` of a border, also in the next block.

    Adds ``block`` (bigint) and ``own``. ``at``, ``width`` and ``halo`` are whole numbers of one unit and
    ``halo`` is at most ``width``.
    """
    block = floor_div(at, width)
    before = F.when(at - block * width < halo, F.struct((block - 1).alias("block"), F.lit(False).alias("own")))
    after = F.when((block + 1) * width - at <= halo, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    copies = F.array_compact(F.array(own, before, after))
    return df.select("*", F.inline(copies))


def in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Whole groups of ``keys`` in one partition each, sorted by the keys and then by ``order``."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)
