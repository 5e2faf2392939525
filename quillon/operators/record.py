"""The forecast record: blended forecasts and their ranges, scores, learning, samples, the gate and the audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.operators.forecasting import chance_below, student_bands
from quillon.operators.joins import numbered
from quillon.operators.stats import quantiles, weighted_quantile

Z80 = 1.2816  # fixed value: half-width of the central 80 % in sigmas


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def blended(models: list[str], weights: list[float], sigma: Column, k: float, news: Column, beta: float, gain: float, drift: Column) -> dict[str, Column]:
    """c0, sigma and c: the weighted models, the calibrated spread, and the centre with gain, news tilt and drift."""
    c0 = total([F.col(m) * w for m, w in zip(models, weights)])
    return {"c0": c0, "sigma": sigma * k, "c": gain * c0 + beta * news * sigma * k + drift}


def chance_up(centre: Column, sigma: Column, nu: int | None) -> Column:
    """Chance that the price ends higher; one half without a spread."""
    return F.when(sigma > 0, chance_below(centre / F.nullif(sigma, F.lit(0.0)), nu)).otherwise(0.5)


def ranges(price: Column, centre: Column, sigma: Column, nu: int, levels: tuple[int, ...] = (50, 80, 95)) -> dict[str, Column]:
    """Prices at both ends of central ranges (centre and sigma in basis points)."""
    out = {}
    for level, z in student_bands(nu, levels).items():
        out[f"lo{level}"] = price * F.exp((centre - z * sigma) / 10_000)
        out[f"hi{level}"] = price * F.exp((centre + z * sigma) / 10_000)
    return out


def spread_ahead(now: Column, long: Column, keep: float, h: int) -> Column:
    """Sum of the variances of the next ``h`` steps when the variance goes back to ``long`` by ``keep`` a step."""
    return h * long + (now - long) * keep * (1 - keep**h) / (1 - keep)


def summaries(cases: DataFrame, keys: list[str], models: list[str], actual: str, sigma: str, moving: float = 1e-9, least: int = 5) -> DataFrame:
    """Scores of the models and of their mean per key, as a prior to learn from.

    n; ``mse_z_m`` and ``rmse_m`` of each model m, in sigmas and as they are; ``hit_m``, the share of moves whose sign
    was right (null under ``least`` moves); of the mean of the models: ens_rmse, ens_hit, cover80 and ``k``, the 0.8
    quantile of its error in sigmas over 1.2816; rmse_rw of no change; sums suu and suv of the mean with itself and with
    the outcome, in sigmas. One partial aggregate and one binned quantile.
    """
    a, s = F.col(actual), F.col(sigma)
    df = cases.withColumn("_ens", total([F.col(m) for m in models]) / len(models)).withColumn("_ze", F.abs(F.col("_ens") - a) / s)
    moves = lambda x: (F.abs(x) > moving) & (F.abs(a) > moving)
    right = lambda x: F.avg(F.when(moves(x), (F.signum(x) == F.signum(a)).cast("double")))
    ens = F.col("_ens")
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in models:
        x = F.col(m)
        aggs += [F.avg(F.pow((x - a) / s, F.lit(2))).alias(f"mse_z_{m}"), F.sqrt(F.avg((x - a) * (x - a))).alias(f"rmse_{m}"), F.when(F.count_if(moves(x)) >= least, right(x)).alias(f"hit_{m}")]
    aggs += [F.sqrt(F.avg(a * a)).alias("rmse_rw"), F.sqrt(F.avg((ens - a) * (ens - a))).alias("ens_rmse"), right(ens).alias("ens_hit"), F.avg((F.col("_ze") <= Z80).cast("double")).alias("cover80")]
    aggs += [F.sum(ens * ens / (s * s)).alias("suu"), F.sum(ens * a / (s * s)).alias("suv")]
    k = quantiles(df, keys, "_ze", {"_k": 0.8}, 0.05)
    return df.groupBy(*keys).agg(*aggs).join(k.select(*keys, (F.col("_k") / Z80).alias("k")), keys)


# fixed values: how many cases a prior counts for, and what the learned numbers may be
PRIOR_MSE, PRIOR_K, PRIOR_GAIN, PRIOR_NEWS, SHARE = 40.0, 30.0, 50.0, 20.0, 0.35
K_LIMITS, GAIN_LIMITS, NEWS_LIMITS = (0.6, 2.5), (-0.5, 1.0), (-0.5, 0.5)


def learned(cases: DataFrame, keys: list[str], models: list[str], weight: str) -> DataFrame:
    """keys, n, weights ``w_m`` of the models, ``k``, ``gain`` and ``beta`` learned from matured cases.

    ``cases``: models, a (outcome), s (spread), k and g used then, c0, c, x (news) and d (drift), and ``weight`` (recent
    cases more). Weights go by the inverse of the mean squared error in spreads, k by the 0.8 quantile of the error of
    the centre, gain by the slope of outcomes on blends, beta by that of what is left on the news; each is drawn to its
    prior and kept within limits. All but the quantile are one partial aggregate.
    """
    w, a, s = F.col(weight), F.col("a"), F.col("s")
    cut = lambda x, limits: F.round(F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), x)), 6)
    df = cases.withColumn("_ze", F.round(F.abs(F.col("c") - a) / s, 6))
    left = (a - F.col("d") - F.col("g") * F.col("c0")) / (s * F.col("k"))
    sums = {f"_m_{m}": F.sum(w * F.pow((F.col(m) - a) / s, F.lit(2))) for m in models}
    sums |= {"_w": F.sum(w), "_uu": F.sum(w * F.pow(F.col("c0") / s, F.lit(2))), "_uv": F.sum(w * F.col("c0") * (a - F.col("d")) / (s * s)), "_rx": F.sum(w * left * F.col("x")), "_xx": F.sum(w * F.col("x") * F.col("x"))}
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in sums.items()))
    q = weighted_quantile(df, keys, "_ze", weight, F.struct(*models, "a", "s"), 0.8, 0.05)
    inverse = {m: (PRIOR_MSE + F.col("_w")) / (PRIOR_MSE + F.col(f"_m_{m}")) for m in models}
    every = total(list(inverse.values()))
    k = (PRIOR_K + F.col("_w") * F.col("value") / Z80) / (PRIOR_K + F.col("_w"))
    return agg.join(q, keys).select(
        *keys, "n", *(F.round(v / every, 6).alias(f"w_{m}") for m, v in inverse.items()), cut(k, K_LIMITS).alias("k"),
        cut(SHARE * F.col("_uv") / (PRIOR_GAIN + SHARE * F.col("_uu")), GAIN_LIMITS).alias("gain"), cut(F.col("_rx") / (PRIOR_NEWS + F.col("_xx")), NEWS_LIMITS).alias("beta"),
    )


def samples(predictions: DataFrame, outcomes: DataFrame, upto: int) -> DataFrame:
    """Predictions joined to the outcomes that batches up to ``upto`` hold: seq, h, a (basis points) and ``place``.

    ``predictions``: seq, h, target, p0; ``outcomes``: pred_seq, h, actual, batch. Void outcomes (null) and outcomes of
    unknown predictions give nothing. ``place`` orders the samples of a horizon by target and seq, oldest first.
    """
    known = outcomes.where((F.col("batch") <= upto) & F.col("actual").isNotNull()).select(F.col("pred_seq").alias("seq"), "h", "actual")
    met = predictions.join(known, ["seq", "h"]).withColumn("a", F.log(F.col("actual") / F.col("p0")) * 10_000)
    return numbered(met, ["h"], F.to_date("target"), ["target", "seq"], "place")


def issuable(series: DataFrame, issued: DataFrame, keys: list[str], least: int, age: Column) -> DataFrame:
    """Series for which a forecast may be issued: keys and origin.

    ``series``: keys, bars, origin, now and target (first one). Enough bars, an origin that has come and is no older
    than ``age``, a first target still ahead, and no forecast issued for that origin (``issued``: keys, origin).
    """
    age_now = F.timestamp_diff("SECOND", F.col("origin"), F.col("now"))
    ready = series.where((F.col("bars") >= least) & (F.col("origin") <= F.col("now")) & (age_now <= age) & (F.col("target") > F.col("now")))
    return ready.join(issued, [*keys, "origin"], "left_anti").select(*keys, "origin")


def audit(predictions: DataFrame, outcomes: DataFrame, prices: DataFrame, horizon_seconds: int, now: Column) -> DataFrame:
    """kind and seq of every rule that a record breaks; one small query a rule, put together.

    ``predictions``: seq, root, pair, origin, issued, p0, w1, w2, w3, c0, g, c, d, h, target (whole seconds).
    ``outcomes``: pred_seq, h, actual, noted. ``prices``: root, pair, ends, close, one row a bar end.
    """
    p = predictions
    at = prices.select("root", "pair", F.col("ends").alias("_ends"), F.col("close").alias("_close"))
    before = p.join(at.withColumnRenamed("_ends", "origin"), ["root", "pair", "origin"], "left")
    o = outcomes.groupBy(F.col("pred_seq").alias("seq"), "h").agg(F.count(F.lit(1)).alias("times"), F.min("noted").alias("noted"), F.max("actual").alias("actual"))
    met = p.join(o, ["seq", "h"], "left").join(at.withColumnRenamed("_ends", "target"), ["root", "pair", "target"], "left")
    far = lambda a, b: F.abs(a - b) > 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    c = F.col
    rules = {
        "issued before its origin": p.where(c("issued") < c("origin")),
        "origin too old": p.where(c("issued") > c("origin") + 7200),
        "target off the calendar": p.where(c("target") != c("origin") + c("h") * horizon_seconds),
        "origin price": before.where(c("_close").isNull() | far(c("p0"), c("_close"))),
        "weights": p.where(F.abs(c("w1") + c("w2") + c("w3") - 1) > 1e-6),
        "centre": p.where(F.abs(c("g") * c("c0") + c("d") - c("c")) > 1e-6),
        "issued twice": p.groupBy("root", "pair", "origin", "h").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")).where("n > 1"),
        "outcome twice": met.where("times > 1"),
        "outcome early": met.where(c("noted") < c("target")),
        "outcome void": met.where(c("times").isNotNull() & c("actual").isNull() & c("_close").isNotNull()),
        "outcome price": met.where(c("actual").isNotNull() & (c("_close").isNull() | far(c("actual"), c("_close")))),
        "due and not scored": met.where(c("times").isNull() & c("_close").isNotNull() & (c("target") <= now)),
        "unknown prediction": outcomes.select(c("pred_seq").alias("seq"), "h").join(p.select("seq", "h"), ["seq", "h"], "left_anti"),
    }
    found = [df.select(F.lit(kind).alias("kind"), "seq") for kind, df in rules.items()]
    return reduce(DataFrame.unionByName, found)


def by_date(losses: DataFrame, keys: list[str], day: str, diff: str) -> DataFrame:
    """Mean difference of losses a key and date, to be tested as one series: pairs move together."""
    return losses.groupBy(*keys, day).agg(F.avg(diff).alias(diff))


def log_density(z: Column, nu: int) -> Column:
    """Logarithm of the density of a t-shaped error at z sigmas, per sigma."""
    import math

    from quillon.operators.forecasting import t_unit

    unit = t_unit(nu)
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(unit)
    return F.lit(const) - (nu + 1) / 2 * F.log1p(z * z / (unit * unit * nu))


def verdict(tune: Column, test: Column, least: float = 2.0) -> Column:
    """adopt: clear in both periods with one sign; fails: clear in the first only; reject: not clear in the first."""
    same = F.signum(tune) == F.signum(test)
    clear = F.abs(tune) >= least
    return F.when(clear & same & (F.abs(test) >= least), "adopt").when(clear, "fails").otherwise("reject")


def strengths(moves: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, cur and strength: least squares of the pairs' moves on base minus quote, strengths adding up to zero.

    ``moves``: keys, base, quote and x, at least ``least`` pairs a key (else no row). Normal equations are sums over
    the pairs, one row a key; of unconnected currencies the least-norm solution is given. Keys run side by side.
    """
    import numpy as np
    import pandas as pd

    both = F.array(F.struct(F.col("base").alias("cur"), F.col("quote").alias("other"), F.col("x").alias("v")), F.struct(F.col("quote").alias("cur"), F.col("base").alias("other"), (-F.col("x")).alias("v")))
    sides = moves.where(F.col("x").isNotNull()).select(*keys, F.inline(both)).groupBy(*keys, "cur", "other").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    rows = sides.groupBy(*keys).agg(F.collect_list(F.struct("cur", "other", "v", "n")).alias("s"), (F.sum("n") / 2).alias("pairs")).where(F.col("pairs") >= least)
    types = dict(moves.dtypes)

    def solve(frames):
        for f in frames:
            out = []
            for key, s in zip(f[keys].itertuples(index=False, name=None), f["s"]):
                names = sorted({e["cur"] for e in s})
                place = {c: i for i, c in enumerate(names)}
                m, b = np.ones((len(names), len(names))), np.zeros(len(names))
                for e in s:
                    i, j = place[e["cur"]], place[e["other"]]
                    m[i, i] += e["n"]
                    m[i, j] -= e["n"]
                    b[i] += e["v"]
                out += [(*key, c, float(x)) for c, x in zip(names, np.linalg.lstsq(m, b, rcond=None)[0])]
            yield pd.DataFrame(out, columns=[*keys, "cur", "strength"])

    return rows.drop("pairs").mapInPandas(solve, ", ".join([*(f"{k} {types[k]}" for k in keys), "cur string, strength double"]))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")


def running(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)
