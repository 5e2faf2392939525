"""Composite operators of the walk-forward studies: expanding regressions, bootstrap, panels, leaders, replays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.operators.batches import bounds, in_order, whole_groups


def expanding_slope(rows: DataFrame, keys: list[str], order: str, x: str, y: str, ready: int, least: int) -> DataFrame:
    """Walk-forward regression of y on x: at each row the slope over the rows at least ``ready`` before it.

    Sufficient statistics are running sums, so the training set of every origin is one window, not a self-join.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -ready)
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = lambda e: F.sum(F.when(known, e)).over(w)
    n = F.count(F.when(known, F.lit(1))).over(w)
    sx, sy, sxx, sxy = s(F.col(x)), s(F.col(y)), s(F.col(x) * F.col(x)), s(F.col(x) * F.col(y))
    var = sxx - sx * sx / F.nullif(n, F.lit(0))
    return rows.withColumns({"trained_on": n, "slope": F.when((n >= least) & (var > 0), (sxy - sx * sy / F.nullif(n, F.lit(0))) / F.nullif(var, F.lit(0.0)))})


def ols(rows: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Least squares per key: keys, n, ``b_const`` and ``b_{feature}``; null where it can't be solved.

    The cross products are one partial aggregate of a fixed number of sums; only they are solved, a row per key.
    """
    xs = {"const": F.lit(1.0), **{f: F.col(f) for f in features}}
    names = list(xs)
    good = F.col(target).isNotNull()
    for f in features:
        good = good & F.col(f).isNotNull()
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(xs[names[i]] * xs[names[j]]).alias(f"_a{i}_{j}") for i, j in upper] + [F.sum(xs[n] * F.col(target)).alias(f"_b{i}") for i, n in enumerate(names)]
    agg = rows.where(good).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[[*keys, "n"]].copy()
            a = np.zeros((len(f), len(names), len(names)))
            for i, j in upper:
                a[:, i, j] = a[:, j, i] = f[f"_a{i}_{j}"]
            b = f[[f"_b{i}" for i in range(len(names))]].to_numpy(float)
            beta = np.full(b.shape, np.nan)
            for k in range(len(f)):
                if np.linalg.matrix_rank(a[k]) == len(names):
                    beta[k] = np.linalg.solve(a[k], b[k])
            for i, n in enumerate(names):
                out[f"b_{n}"] = pd.Series(beta[:, i], index=out.index).astype(object).where(np.isfinite(beta[:, i]), None)
            yield out

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "n bigint", *(f"b_{n} double" for n in names)])
    return agg.mapInPandas(solve, schema)


def bootstrap_mean(rows: DataFrame, keys: list[str], value: str, ident: Column, draws: int = 200, seed: int = 1) -> DataFrame:
    """keys, mean, and the 2.5 and 97.5 % quantiles of the mean over Poisson resamples.

    A row's weight in a draw comes from a hash of the row and the draw, so draws are summed where the rows lie:
    the shuffle carries one row per key and draw. Weights follow the Poisson(1) distribution.
    """
    cuts = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676]  # fixed values: its distribution function
    each = rows.where(F.col(value).isNotNull()).select(*keys, value, ident.alias("_id"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    u = F.pmod(F.xxhash64(F.lit(seed), "_draw", "_id"), F.lit(1_000_003)) / 1_000_003
    weight = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    sums = each.withColumn("_w", weight).groupBy(*keys, "_draw").agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"), F.avg(value).alias("_all"))
    return sums.groupBy(*keys).agg(F.first("_all").alias("mean"), F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))


def panel_t(rows: DataFrame, keys: list[str], at: str, value: str, lag: int) -> DataFrame:
    """keys, periods and t of the mean with errors robust to dependence across the panel and over ``lag`` periods.

    Values are summed by period first; the products of lagged sums are window columns over the periods.
    """
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    centred = rows.join(mean, keys).groupBy(*keys, at).agg(F.sum(F.col(value) - F.col("_mean")).alias("_s"), F.first("_mean").alias("_mean"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(at)
    steps = {f"_c{i}": F.col("_s") * F.lag("_s", i).over(w) for i in range(1, lag + 1)}
    agg = centred.withColumns(steps).groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"), F.first("_mean").alias("_m"), F.first("_n").alias("_n"), F.sum(F.col("_s") * F.col("_s")).alias("_v"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in steps))
    var = F.col("_v")
    for i in range(1, lag + 1):
        var = var + 2 * (1 - i / (lag + 1)) * F.col(f"_c{i}")
    return agg.select(*keys, "periods", F.when(var > 0, F.col("_m") * F.col("_n") / F.sqrt(F.when(var > 0, var))).alias("t"))


def leaders(pairs: DataFrame, items: DataFrame, ident: str, order: str) -> DataFrame:
    """ident, story: each item joins the earliest item that is alike and itself leads; else it leads.

    An item whose alike earlier items are known to follow or lead is decided; deciding is repeated until none is
    left, so the number of rounds is the longest chain of alike items. A round joins the links that are still open to
    what the round before decided, and writes both down; what is decided is not touched again.
    """
    from quillon.session import durable

    when = items.select(F.col(ident).alias("_i"), F.struct(order, ident).alias("_o"))
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    links = both.join(when.select(F.col("_i").alias("x"), F.col("_o").alias("_ox")), "x").join(when.select(F.col("_i").alias("y"), F.col("_o").alias("_oy")), "y")
    links = durable(links.where(F.col("_oy") < F.col("_ox")).select("x", "y", "_oy").distinct())  # y is the earlier one
    first = items.select(F.col(ident).alias("i")).join(links.select(F.col("x").alias("i")).distinct(), "i", "left_anti")
    new = durable(first.withColumn("story", F.col("i")))
    parts, open_ = [new], links.withColumn("lead", F.lit(None).cast("boolean"))
    while True:
        told = new.select(F.col("i").alias("y"), (F.col("story") == F.col("i")).alias("_l"))
        open_ = durable(open_.join(told, "y", "left").select("x", "y", "_oy", F.coalesce("lead", "_l").alias("lead")))
        unknown = F.col("lead").isNull()
        judged = open_.groupBy("x").agg(F.count_if(unknown).alias("unknown"), F.min_by("y", F.when(F.col("lead"), F.col("_oy"))).alias("leader"), F.min(F.when(unknown, F.col("_oy"))).alias("first_unknown"), F.min(F.when(F.col("lead"), F.col("_oy"))).alias("first_lead"))
        ready = judged.where((F.col("unknown") == 0) | (F.col("first_lead") < F.col("first_unknown")))
        new = durable(ready.select(F.col("x").alias("i"), F.coalesce("leader", "x").alias("story")))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, parts).select(F.col("i").alias(ident), "story")
        parts.append(new)
        open_ = open_.join(new.select(F.col("i").alias("x")), "x", "left_anti")


def replay_scale(cases: DataFrame, keys: list[str], order: str, size: str, half_life: float = 100.0, prior: float = 30.0, q: float = 0.8, z: float = 1.2816) -> DataFrame:
    """The scale that a learner would have used at each case from the cases before it, kept in a decayed histogram.

    Each step depends on the one before it, so a key is walked in order; all keys of a batch are walked side by side.
    """
    edges = np.exp(np.linspace(np.log(1e-3), np.log(1e3), 601))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            value = table.column(size).to_numpy()
            cell = np.clip(np.searchsorted(edges, value), 0, len(edges) - 1)
            out, keep = np.empty(len(value)), 0.5 ** (1 / half_life)
            first, length = bounds(group)
            order_ = np.argsort(-length, kind="stable")
            first, length = first[order_], length[order_]
            held = np.zeros((len(first), len(edges)))
            for t in range(int(length[0])):
                n = int(np.searchsorted(-length, -t, side="left"))  # keys that have a case at this step
                at, own = first[:n] + t, held[:n]
                run = np.cumsum(own, axis=1)
                total = run[:, -1]
                k = np.where(total > 0, edges[(run < q * total[:, None]).sum(axis=1).clip(0, len(edges) - 1)] / z, 1.0)
                out[at] = (prior + total * k) / (prior + total)
                own *= keep
                own[np.arange(n), cell[at]] += 1
            yield from table.append_column("scale", pa.array(out)).to_batches()

    types = dict(cases.dtypes)
    rows = in_order(cases.select(*keys, order, size), keys, order)
    return rows.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in (*keys, order, size)), "scale double"]))
