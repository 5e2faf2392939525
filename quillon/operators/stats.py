"""Scores and tests as expressions over aggregates; the few special functions run on aggregated rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a rate; 0 to 1 without cases."""
    p = hits / F.nullif(n, F.lit(0))
    den = 1 + z * z / F.nullif(n, F.lit(0))
    centre = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / den
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * n)) / den
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))


@pandas_udf(DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the normal distribution."""
    return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2)))


@pandas_udf(DoubleType())
def two_sided(hits: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided binomial p-value at one half: exact up to 400 trials, then the normal with continuity."""

    def one(k: int, m: int) -> float | None:
        if m <= 0:
            return None
        if m > 400:
            return min(1.0, math.erfc(max((abs(k - m / 2) - 0.5) / math.sqrt(m / 4), 0.0) / math.sqrt(2)))
        lesser = min(k, m - k)
        tail = sum(math.comb(m, i) for i in range(lesser + 1)) / 2.0**m
        return min(1.0, 2 * tail)

    return pd.Series([one(int(k), int(m)) for k, m in zip(hits, n)], dtype="float64")


def diebold_mariano(losses: DataFrame, keys: list[str], order: str, diff: str, lag: int) -> DataFrame:
    """keys, n and dm: mean loss difference over its Newey-West error with Bartlett weights; null under 8 cases."""
    w = Window.partitionBy(*keys)
    centred = losses.withColumn("_d", F.col(diff) - F.avg(diff).over(w))
    steps = {f"_c{i}": F.col("_d") * F.lag("_d", i).over(w.orderBy(order)) for i in range(1, lag + 1)}
    agg = centred.withColumns(steps).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("_m"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in steps))
    var = F.col("_v") / F.col("n")
    for i in range(1, lag + 1):
        var = var + 2 * (1 - i / (lag + 1)) * F.col(f"_c{i}") / F.col("n")
    return agg.select(*keys, "n", F.when((F.col("n") >= 8) & (var > 0), F.col("_m") / F.sqrt(F.when(var > 0, var) / F.col("n"))).alias("dm"))


def auc(rows: DataFrame, keys: list[str], score: str, label: str, order: str, width: float = 1.0) -> DataFrame:
    """Area under the curve by ordinal ranks (ties by ``order``).

    A rank is the number of cases in lower bins of the score (running counts over the bins, few rows) and the
    place within the bin, so no task sorts all cases of a key.
    """
    binned = rows.withColumn("_bin", F.floor(F.col(score) / width).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(score, order))
    placed = binned.withColumn("_k", within).join(bins, [*keys, "_bin"])
    rank = F.col("_k") + F.col("_ahead")
    ranked = placed.groupBy(*keys).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"), F.sum(F.when(F.col(label), rank)).alias("s"))
    pairs = F.nullif(F.col("p") * F.col("q"), F.lit(0))
    return ranked.select(*keys, ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / pairs).alias("auc"))


def block_t(rows: DataFrame, keys: list[str], block: str, value: str) -> DataFrame:
    """t of the sums of blocks: mean over sample deviation times the root of the number of blocks."""
    sums = rows.groupBy(*keys, block).agg(F.sum(value).alias("_s"))
    return sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), (F.avg("_s") / F.nullif(F.stddev_samp("_s"), F.lit(0.0)) * F.sqrt(F.count(F.lit(1)))).alias("t"))


def weighted_quantile(rows: DataFrame, keys: list[str], value: str, weight: str, order: str | Column, q: float, width: float = 1.0) -> DataFrame:
    """The smallest value at which the running weight reaches q of the total, without interpolation.

    Weights are summed by bins of ``width`` first; only the rows of the bin in which q is reached are put in order, so
    no task holds a key.
    """
    binned = rows.where(F.col(value).isNotNull()).withColumn("_bin", F.floor(F.col(value) / width).cast("long"))
    all_ = Window.partitionBy(*keys)
    upto = all_.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = binned.groupBy(*keys, "_bin").agg(F.sum(weight).alias("_w")).withColumns({"_upto": F.sum("_w").over(upto), "_all": F.sum("_w").over(all_)})
    open_ = bins.where((F.col("_upto") >= q * F.col("_all") - 1e-12) & (F.col("_upto") - F.col("_w") < q * F.col("_all") - 1e-12))
    inside = binned.join(open_, [*keys, "_bin"])
    w = Window.partitionBy(*keys, "_bin").orderBy(value, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = inside.withColumn("_run", F.col("_upto") - F.col("_w") + F.sum(weight).over(w))
    return run.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_run") >= q * F.col("_all") - 1e-12, F.col(value))), F.max(value)).alias("value"))


def quantiles(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float], width: float = 1.0, bins: Column | None = None) -> DataFrame:
    """keys and the exact quantiles (linear) named in ``levels``, of the known values.

    Counts by bins of ``width`` (or ``bins``, whole numbers that rise with the value) find the bins that the wanted places lie in; only their rows are put in order. No task
    holds a key's values, however many there are.
    """
    binned = rows.where(F.col(value).isNotNull()).withColumn("_bin", (F.floor(F.col(value) / width) if bins is None else bins).cast("long"))
    all_ = Window.partitionBy(*keys)
    bins = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    bins = bins.withColumns({"_upto": F.sum("_n").over(all_.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_all": F.sum("_n").over(all_)})
    wanted = F.array(*(F.struct(F.lit(name).alias("_name"), (q * (F.col("_all") - 1)).alias("_place")) for name, q in levels.items()))
    low, high = F.floor("_place"), F.ceil("_place")
    hit = lambda p: (F.col("_upto") - F.col("_n") <= p) & (p < F.col("_upto"))
    open_ = bins.select("*", F.inline(wanted)).where(hit(low) | hit(high))
    ordered = binned.join(open_.select(*keys, "_bin", "_n", "_upto").distinct(), [*keys, "_bin"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(value)) - 1 + F.col("_upto") - F.col("_n")
    ordered = ordered.select(*keys, "_bin", F.col(value).alias("_v"), rank.alias("_rank"))
    met = open_.join(ordered, [*keys, "_bin"]).where((F.col("_rank") == low) | (F.col("_rank") == high))
    ends = met.groupBy(*keys, "_name", "_place").agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    ends = ends.withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_place") - low))
    return ends.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in levels))


def gaussian_crps(error: Column, sd: Column, density: Column, below: Column) -> Column:
    """CRPS of a normal forecast from the density and distribution at the standardised error."""
    z = error / sd
    return sd * (z * (2 * below - 1) + 2 * density - 1 / math.sqrt(math.pi))


def normal_cdf(z: Column) -> Column:
    """Distribution of the standard normal by a rational approximation (absolute error under 1.5e-7).

    Fixed values: the coefficients of the approximation.
    """
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)
