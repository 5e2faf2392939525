"""Queries of scores, tests, window statistics, seasonality and variance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.operators import bars as B, season as N, stats as P, trades as T, variance as M, windows as V
from quillon.plans.shared import BARS, KEY, Registry, W, bars_of, shown, stamp
from quillon.sources.tables import SERIES, small, table

query = Registry()
QUERIES, ORACLE = query.queries, query.sql

RETURNS = f"{BARS}, r AS (SELECT *, (ln(close) - ln(lag(close) OVER ({W}))) * 10000 AS x, (ln(lead(close) OVER ({W})) - ln(close)) * 10000 AS y FROM bars)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the last move x and the next move y in basis points."""
    w = B.series_window()
    return bars_of(spark, sf_dir).withColumns({"x": B.log_return_bp(), "y": (F.log(F.lead("close").over(w)) - F.log("close")) * 10_000})


@query("log_returns", f"WITH {RETURNS} SELECT {KEY}, round(x, 6) AS x FROM r")
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(returns(spark, sf_dir), ["x"])


@query("forward_returns", f"WITH {BARS} SELECT {KEY}, round((ln(lead(close, 4) OVER ({W})) - ln(close)) * 10000, 6) AS f4, round(max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 9) AS top4 FROM bars")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = B.series_window()
    df = bars_of(spark, sf_dir).withColumns({"f4": (F.log(F.lead("close", 4).over(w)) - F.log("close")) * 10_000, "top4": F.max("high").over(w.rowsBetween(1, 4))})
    return df.select(*SERIES, stamp(), F.round(F.col("f4"), 6).alias("f4"), F.round(F.col("top4"), 9).alias("top4"))


@query("gap_island", f"""WITH {BARS}, g AS (SELECT b.*, CASE WHEN minutes > 0 THEN minutes ELSE 1440 END AS m, lag(bar_time) OVER ({W}) AS p FROM bars b JOIN timeframes USING (tf)), h AS (SELECT *, CASE WHEN p IS NULL OR epoch_us(bar_time) - epoch_us(p) > m::BIGINT * 60000000 THEN 1 ELSE 0 END AS s FROM g),
i AS (SELECT *, sum(s) OVER ({W}) AS island FROM h) SELECT root, pair, tf, CAST(island AS BIGINT) AS island, count(*) AS bars, strftime(min(bar_time), '%Y-%m-%d %H:%M:%S') AS begins FROM i GROUP BY root, pair, tf, island""")
def gap_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of bars without a pause."""
    minutes = small(table(spark, sf_dir, "timeframes").select("tf", F.when(F.col("minutes") > 0, F.col("minutes")).otherwise(1440).alias("m")))
    w = B.series_window()
    pause = F.timestamp_diff("MICROSECOND", F.lag("bar_time").over(w), F.col("bar_time")) > F.col("m").cast("long") * 60_000_000
    df = bars_of(spark, sf_dir).join(minutes, "tf").withColumn("s", F.when(F.lag("bar_time").over(w).isNull() | pause, 1).otherwise(0))
    df = df.withColumn("island", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return df.groupBy(*SERIES, "island").agg(F.count(F.lit(1)).alias("bars"), F.date_format(F.min("bar_time"), "yyyy-MM-dd HH:mm:ss").alias("begins"))


@query("rolling_quantile_filter", f"""WITH {RETURNS}, v AS (SELECT *, CASE WHEN count(x) OVER ({W} ROWS 9 PRECEDING) >= 10 THEN stddev_samp(x) OVER ({W} ROWS 9 PRECEDING) END AS rv FROM r),
l AS (SELECT *, CASE WHEN count(rv) OVER ({W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) >= 10 THEN quantile_cont(rv, 0.8) OVER ({W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) END AS lim FROM v)
SELECT {KEY}, round(rv, 6) AS rv, round(lim, 6) AS lim, NOT coalesce(rv > lim + 1e-9, false) AS allowed FROM l""")
def rolling_quantile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether volatility is at most the 0.8 quantile of its last 40 values; unknown limits don't block."""
    df = returns(spark, sf_dir).withColumn("rv", V.gated(F.stddev_samp("x").over(B.trailing(10)), "x", 10))
    df = df.withColumn("lim", V.rolling_quantile("rv", 40, 0.8, 10))
    return shown(df.withColumn("allowed", ~F.coalesce(F.col("rv") > F.col("lim") + 1e-9, F.lit(False))), ["rv", "lim", "allowed"])


@query("vol_percentile", f"""WITH {RETURNS}, v AS (SELECT *, CASE WHEN count(x) OVER ({W} ROWS 23 PRECEDING) >= 24 THEN round(sqrt(sum(x * x) OVER ({W} ROWS 23 PRECEDING)), 6) END AS vol FROM r), h AS (SELECT *, list(vol) OVER ({W} ROWS 99 PRECEDING) AS past FROM v)
SELECT {KEY}, vol, round(len(list_filter(past, lambda p: p <= vol)) / nullif(len(list_filter(past, lambda p: p IS NOT NULL)), 0), 6) AS pct FROM h WHERE vol IS NOT NULL""")
def vol_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of 24 bars and the share of the last 100 values that are not greater."""
    vol = V.gated(F.sqrt(F.sum(F.col("x") * F.col("x")).over(B.trailing(24))), "x", 24)
    df = returns(spark, sf_dir).withColumn("vol", F.round(vol, 6)).withColumn("past", F.collect_list("vol").over(B.trailing(100)))
    df = df.where(F.col("vol").isNotNull()).withColumn("pct", F.size(F.filter("past", lambda p: p <= F.col("vol"))) / F.size("past"))
    return df.select(*SERIES, stamp(), "vol", F.round(F.col("pct"), 6).alias("pct"))


@query("trend_state", f"""WITH {BARS}, s AS (SELECT *, CASE WHEN count(close) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN round(avg(close) OVER ({W} ROWS 19 PRECEDING), 9) END AS a, CASE WHEN count(close) OVER ({W} ROWS 74 PRECEDING) >= 75 THEN round(avg(close) OVER ({W} ROWS 74 PRECEDING), 9) END AS b FROM bars),
t AS (SELECT *, lag(a, 5) OVER ({W}) AS a5 FROM s) SELECT {KEY}, CASE WHEN close > a AND a > b AND a > a5 THEN 'up' WHEN close < a AND a < b AND a < a5 THEN 'down' WHEN b IS NULL THEN 'unknown' ELSE 'range' END AS trend FROM t""")
def trend_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars_of(spark, sf_dir).withColumns({"a": F.round(V.sma("close", 20), 9), "b": F.round(V.sma("close", 75), 9)})
    df = df.withColumn("a5", F.lag("a", 5).over(B.series_window()))
    c, a, b, a5 = (F.col(x) for x in ("close", "a", "b", "a5"))
    return shown(df.withColumn("trend", F.when((c > a) & (a > b) & (a > a5), "up").when((c < a) & (a < b) & (a < a5), "down").when(b.isNull(), "unknown").otherwise("range")), ["trend"])


@query("timeline", f"""WITH {RETURNS}, s AS (SELECT *, CASE WHEN x * y > 0 THEN 1.0 ELSE 0.0 END AS hit, row_number() OVER ({W}) AS n, count(*) OVER (PARTITION BY root, pair, tf) AS total FROM r WHERE x IS NOT NULL AND y IS NOT NULL AND abs(x) > 1e-9 AND abs(y) > 1e-9)
SELECT {KEY}, n, round(rate, 10) AS rate FROM (SELECT *, sum(hit) OVER ({W} ROWS UNBOUNDED PRECEDING) / n AS rate FROM s) WHERE n % greatest(1, (total + 159) // 160) = 0 OR n = total""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running hit rate of carrying the last move on, at about 160 points of each series."""
    w = B.series_window()
    df = returns(spark, sf_dir).where((F.abs("x") > 1e-9) & (F.abs("y") > 1e-9))
    df = df.withColumns({"hit": (F.col("x") * F.col("y") > 0).cast("double"), "n": F.row_number().over(w).cast("long"), "total": F.count(F.lit(1)).over(Window.partitionBy(*SERIES))})
    df = df.withColumn("rate", F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.col("n"))
    return shown(df.where((F.col("n") % F.greatest(F.lit(1), F.floor((F.col("total") + 159) / 160)) == 0) | (F.col("n") == F.col("total"))), ["n", "rate"], 10)


@query("drawdown", f"""WITH {RETURNS}, c AS (SELECT *, sum(coalesce(x, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum FROM r), m AS (SELECT *, greatest(0, max(cum) OVER ({W} ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM c)
SELECT root, pair, tf, round(max(dd), 5) AS drawdown, round(arg_max(cum, bar_time), 5) AS final FROM m GROUP BY root, pair, tf""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = B.series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = returns(spark, sf_dir).withColumn("cum", F.sum(F.coalesce("x", F.lit(0.0))).over(so_far))
    df = df.withColumn("dd", F.greatest(F.lit(0.0), F.max("cum").over(so_far)) - F.col("cum"))
    return df.groupBy(*SERIES).agg(F.round(F.max("dd"), 5).alias("drawdown"), F.round(F.max_by("cum", "bar_time"), 5).alias("final"))


@query("trailing_buckets", f"""WITH {RETURNS}, b AS (SELECT root, pair, tf, date_trunc('week', bar_time) AS week, count(*) AS n, sum(x * x) AS s FROM r WHERE x IS NOT NULL GROUP BY ALL)
SELECT root, pair, tf, strftime(week, '%Y-%m-%d') AS week, CAST(sum(n) OVER w AS BIGINT) AS n, round(sqrt(sum(s) OVER w / sum(n) OVER w), 6) AS rms FROM b WINDOW w AS (PARTITION BY root, pair, tf ORDER BY week ROWS 4 PRECEDING)""")
def trailing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks with bars, rolled over five of them."""
    weeks = returns(spark, sf_dir).where(F.col("x").isNotNull()).groupBy(*SERIES, F.date_trunc("week", "bar_time").alias("week")).agg(F.count(F.lit(1)).alias("n0"), F.sum(F.col("x") * F.col("x")).alias("s"))
    w = Window.partitionBy(*SERIES).orderBy("week").rowsBetween(-4, 0)
    rms = F.sqrt(F.sum("s").over(w) / F.sum("n0").over(w))
    return weeks.select(*SERIES, F.date_format("week", "yyyy-MM-dd").alias("week"), F.sum("n0").over(w).alias("n"), F.round(rms, 6).alias("rms"))


@query("time_rolling", f"""WITH {RETURNS}, d AS (SELECT root, pair, tf, CAST(bar_time AS DATE) AS day, count(*) AS n, count(*) FILTER (abs(x) <= 10) AS inside FROM r WHERE x IS NOT NULL GROUP BY ALL)
SELECT root, pair, tf, strftime(day, '%Y-%m-%d') AS day, round(sum(inside) OVER w / sum(n) OVER w, 6) AS coverage FROM d WINDOW w AS (PARTITION BY root, pair, tf ORDER BY day RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW)""")
def time_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of moves within 10 bp over the last 60 days, from daily counts."""
    days = returns(spark, sf_dir).where(F.col("x").isNotNull()).groupBy(*SERIES, F.to_date("bar_time").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("x") <= 10).alias("inside"))
    w = Window.partitionBy(*SERIES).orderBy(F.unix_date("day")).rangeBetween(-59, 0)
    return days.select(*SERIES, F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.sum("inside").over(w) / F.sum("n").over(w), 6).alias("coverage"))


@query("recency_weights", f"WITH {BARS}, n AS (SELECT b.*, half_life, row_number() OVER (PARTITION BY root, pair, b.tf ORDER BY bar_time DESC) - 1 AS age FROM bars b JOIN timeframes USING (tf)) SELECT {KEY}, round(pow(0.5, age / half_life), 6) AS weight FROM n")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lives = small(table(spark, sf_dir, "timeframes").select("tf", "half_life"))
    age = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())) - 1
    return shown(bars_of(spark, sf_dir).join(lives, "tf").withColumn("weight", F.pow(F.lit(0.5), age / F.col("half_life"))), ["weight"])


@query("month_position", f"WITH {BARS}, d AS (SELECT DISTINCT root, pair, CAST(bar_time AS DATE) AS day FROM bars WHERE tf = '1d') SELECT root, pair, strftime(day, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY root, pair, date_trunc('month', day) ORDER BY day) AS from_start, row_number() OVER (PARTITION BY root, pair, date_trunc('month', day) ORDER BY day DESC) - 1 AS to_end FROM d")
def month_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars_of(spark, sf_dir).where("tf = '1d'").select("root", "pair", F.to_date("bar_time").alias("day")).distinct()
    w = Window.partitionBy("root", "pair", F.trunc("day", "month"))
    return days.select("root", "pair", F.date_format("day", "yyyy-MM-dd").alias("day"), F.row_number().over(w.orderBy("day")).cast("long").alias("from_start"), (F.row_number().over(w.orderBy(F.col("day").desc())) - 1).cast("long").alias("to_end"))


@query("session_breakout", f"""WITH {BARS}, h AS (SELECT *, CAST(bar_time AS DATE) AS day, hour(bar_time) AS hr FROM bars WHERE tf = '1h'), g AS (SELECT root, pair, day, max(high) AS top, min(low) AS bottom FROM h WHERE hr < 7 GROUP BY ALL),
b AS (SELECT h.root, h.pair, h.day, h.bar_time, CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 END AS side FROM h JOIN g USING (root, pair, day) WHERE hr BETWEEN 7 AND 11 AND (close > top OR close < bottom))
SELECT root, pair, strftime(day, '%Y-%m-%d') AS day, arg_min(side, bar_time) AS side, min(hour(bar_time)) AS hour FROM b GROUP BY root, pair, day""")
def session_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First close beyond the range of 00-07 UTC between 07 and 12 UTC."""
    h = bars_of(spark, sf_dir).where("tf = '1h'").withColumns({"day": F.to_date("bar_time"), "hr": F.hour("bar_time")})
    day = Window.partitionBy("root", "pair", "day")
    early = F.col("hr") < 7
    h = h.withColumns({"top": F.max(F.when(early, F.col("high"))).over(day), "bottom": F.min(F.when(early, F.col("low"))).over(day)})
    side = F.when(F.col("close") > F.col("top"), 1).when(F.col("close") < F.col("bottom"), -1)
    broken = h.withColumn("side", side).where(F.col("hr").between(7, 11) & F.col("side").isNotNull())
    return broken.groupBy("root", "pair", "day").agg(F.min_by("side", "bar_time").alias("side"), F.min("hr").cast("long").alias("hour")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


WILSON = "greatest(0, ({h} / {n}::DOUBLE + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) - 1.96 * sqrt({h} / {n}::DOUBLE * (1 - {h} / {n}::DOUBLE) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}))"


@query("hit_scores", f"""WITH {RETURNS}, s AS (SELECT tf, count(*) AS n, count(*) FILTER (abs(x) > 1e-9 AND abs(y) > 1e-9) AS n_dir, count(*) FILTER (x * y > 0 AND abs(x) > 1e-9 AND abs(y) > 1e-9) AS hits, sqrt(avg((0.1 * x - y) * (0.1 * x - y))) AS rmse, sqrt(avg(y * y)) AS rmse_rw, avg(abs(0.1 * x - y)) AS mae
FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY tf) SELECT tf, n, n_dir, hits, round({WILSON.format(h='hits', n='n_dir')}, 6) AS lo, round(rmse, 5) AS rmse, round(1 - rmse / rmse_rw, 6) AS skill, round(mae, 5) AS mae FROM s""")
def hit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a tenth of the last move as a forecast of the next, by timeframe."""
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    moving = (F.abs("x") > 1e-9) & (F.abs("y") > 1e-9)
    err = 0.1 * F.col("x") - F.col("y")
    s = df.groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.count_if(moving).alias("n_dir"), F.count_if(moving & (F.col("x") * F.col("y") > 0)).alias("hits"), F.sqrt(F.avg(err * err)).alias("rmse"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rw"), F.avg(F.abs(err)).alias("mae"))
    low, _ = P.wilson(F.col("hits"), F.col("n_dir"))
    return s.select("tf", "n", "n_dir", "hits", F.round(low, 6).alias("lo"), F.round(F.col("rmse"), 5).alias("rmse"), F.round(1 - F.col("rmse") / F.col("rw"), 6).alias("skill"), F.round(F.col("mae"), 5).alias("mae"))


@query("grouping_sets_scores", f"""WITH {RETURNS} SELECT coalesce(tf, 'all') AS tf, coalesce(pair, 'all') AS pair, coalesce(CAST(year(bar_time) AS VARCHAR), 'all') AS year, count(*) AS n, count(*) FILTER (x * y > 0) AS hits, round(avg(y), 5) AS mean
FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY GROUPING SETS ((tf), (tf, pair), (tf, CAST(year(bar_time) AS VARCHAR)), ())""".replace("coalesce(CAST(year(bar_time) AS VARCHAR), 'all') AS year", "coalesce(yr, 'all') AS year").replace("CAST(year(bar_time) AS VARCHAR))", "yr)").replace("FROM r WHERE", "FROM (SELECT *, CAST(year(bar_time) AS VARCHAR) AS yr FROM r) WHERE"))
def grouping_sets_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts at four grains in one pass."""
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("year", F.year("bar_time").cast("string"))
    sets = df.groupingSets([["tf"], ["tf", "pair"], ["tf", "year"], []], "tf", "pair", "year")
    g = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") * F.col("y") > 0).alias("hits"), F.round(F.avg("y"), 5).alias("mean"))
    return g.select(*(F.coalesce(c, F.lit("all")).alias(c) for c in ("tf", "pair", "year")), "n", "hits", "mean")


@query("calibration", f"""WITH {RETURNS}, p AS (SELECT *, 1 / (1 + exp(-x / 10)) AS p FROM r WHERE x IS NOT NULL AND y IS NOT NULL) SELECT tf, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 6) AS said, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS was,
round(avg(pow(p - CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END, 2)), 6) AS brier FROM p GROUP BY ALL""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability bins (the last one closed) against what happened."""
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("p", 1 / (1 + F.exp(-F.col("x") / 10)))
    up = (F.col("y") > 0).cast("double")
    bins = F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long")
    return df.groupBy("tf", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("said"), F.round(F.avg(up), 6).alias("was"), F.round(F.avg(F.pow(F.col("p") - up, 2)), 6).alias("brier"))


@query("dm_test", f"""WITH {RETURNS}, d AS (SELECT root, pair, tf, bar_time, pow(0.1 * x - y, 2) - pow(y, 2) AS d FROM r WHERE x IS NOT NULL AND y IS NOT NULL), c AS (SELECT *, d - avg(d) OVER (PARTITION BY root, pair, tf) AS e FROM d),
l AS (SELECT *, e * lag(e, 1) OVER ({W}) AS e1, e * lag(e, 2) OVER ({W}) AS e2 FROM c), a AS (SELECT root, pair, tf, count(*) AS n, avg(d) AS m, sum(e * e) / count(*) + 2 * (1 - 1.0 / 3) * sum(e1) / count(*) + 2 * (1 - 2.0 / 3) * sum(e2) / count(*) AS v FROM l GROUP BY ALL)
SELECT root, pair, tf, n, round(CASE WHEN n >= 8 AND v > 0 THEN m / sqrt(v / n) END, 5) AS dm FROM a""")
def dm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    df = df.withColumn("d", F.pow(0.1 * F.col("x") - F.col("y"), 2) - F.pow("y", F.lit(2)))
    return P.diebold_mariano(df, SERIES, "bar_time", "d", 2).withColumn("dm", F.round(F.col("dm"), 5))


@query("block_t", f"WITH {RETURNS}, b AS (SELECT tf, date_trunc('week', bar_time) AS week, sum(sign(x) * y) AS s FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL) SELECT tf, count(*) AS blocks, round(avg(s) / stddev_samp(s) * sqrt(count(*)), 5) AS t FROM b GROUP BY tf")
def block_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    df = df.withColumns({"week": F.date_trunc("week", "bar_time"), "v": F.signum("x") * F.col("y")})
    return P.block_t(df, ["tf"], "week", "v").withColumn("t", F.round(F.col("t"), 5))


@query("auc", f"""WITH {RETURNS}, k AS (SELECT tf, y > 0 AS up, row_number() OVER (PARTITION BY tf ORDER BY round(x, 6), root, pair, bar_time) AS n FROM r WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT tf, round((sum(n) FILTER (up) - count(*) FILTER (up) * (count(*) FILTER (up) + 1) / 2) / (count(*) FILTER (up) * count(*) FILTER (NOT up)), 8) AS auc FROM k GROUP BY tf""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    df = df.select("tf", F.round(F.col("x"), 6).alias("score"), (F.col("y") > 0).alias("up"), F.struct("root", "pair", "bar_time").alias("tie"))
    return P.auc(df, ["tf"], "score", "up", "tie").withColumn("auc", F.round(F.col("auc"), 8))


def cdf_sql(z: str) -> str:
    """The same rational approximation in SQL."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    tail = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z} / 2))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} / 2 ELSE {tail} / 2 END"


@query("crps_gauss", f"""WITH {RETURNS}, d AS (SELECT tf, y, CASE WHEN count(x) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN stddev_pop(x) OVER ({W} ROWS 19 PRECEDING) END AS sd FROM r), z AS (SELECT tf, sd, y / sd AS z FROM d WHERE sd > 0 AND y IS NOT NULL)
SELECT tf, count(*) AS n, round(avg(sd * (z * (2 * ({cdf_sql('z')}) - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 4) AS crps FROM z GROUP BY tf""")
def crps_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean CRPS of a normal forecast with the deviation of the last 20 moves."""
    df = returns(spark, sf_dir).withColumn("sd", V.gated(F.stddev_pop("x").over(B.trailing(20)), "x", 20)).where((F.col("sd") > 0) & F.col("y").isNotNull())
    z = F.col("y") / F.col("sd")
    crps = P.gaussian_crps(F.col("y"), F.col("sd"), F.exp(-z * z / 2) / math.sqrt(2 * math.pi), P.normal_cdf(z))
    return df.groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(crps), 4).alias("crps"))


@query("qlike", f"""WITH {RETURNS}, v AS (SELECT tf, y * y AS real, CASE WHEN count(x) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN avg(x * x) OVER ({W} ROWS 19 PRECEDING) END AS said FROM r) SELECT tf, count(*) AS n, round(avg(real / said - ln(real / said) - 1), 5) AS qlike FROM v WHERE said > 0 AND real > 0 GROUP BY tf""")
def qlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).withColumns({"said": V.gated(F.avg(F.col("x") * F.col("x")).over(B.trailing(20)), "x", 20), "real": F.col("y") * F.col("y")})
    ratio = F.col("real") / F.col("said")
    return df.where("said > 0 AND real > 0").groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ratio - F.log(ratio) - 1), 5).alias("qlike"))


@query("pinball", f"""WITH {RETURNS}, q AS (SELECT tf, tau, y - tau * 10 + 5 AS e FROM r, (SELECT unnest([0.1, 0.5, 0.9]) AS tau) WHERE y IS NOT NULL) SELECT tf, tau, round(avg(CASE WHEN e >= 0 THEN tau * e ELSE (tau - 1) * e END), 6) AS loss FROM q GROUP BY ALL""")
def pinball(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("y").isNotNull()).select("tf", "y", F.explode(F.array(*(F.lit(t) for t in (0.1, 0.5, 0.9)))).alias("tau"))
    e = F.col("y") - F.col("tau") * 10 + 5
    return df.groupBy("tf", "tau").agg(F.round(F.avg(F.when(e >= 0, F.col("tau") * e).otherwise((F.col("tau") - 1) * e)), 6).alias("loss"))


@query("weighted_quantile", f"""WITH {RETURNS}, a AS (SELECT root, pair, tf, bar_time, round(abs(y), 6) AS v, row_number() OVER (PARTITION BY root, pair, tf ORDER BY bar_time DESC) - 1 AS age FROM r WHERE y IS NOT NULL), w AS (SELECT *, pow(0.5, age / 100.0) AS w FROM a),
c AS (SELECT *, sum(w) OVER (PARTITION BY root, pair, tf ORDER BY v, bar_time ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY root, pair, tf) AS total FROM w) SELECT root, pair, tf, min(v) AS value FROM c WHERE run >= 0.8 * total - 1e-12 GROUP BY root, pair, tf""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("y").isNotNull())
    age = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())) - 1
    df = df.select(*SERIES, "bar_time", F.round(F.abs("y"), 6).alias("v"), F.pow(F.lit(0.5), age / 100.0).alias("w"))
    return P.weighted_quantile(df, SERIES, "v", "w", "bar_time", 0.8)


@query("histogram_quantile", f"""WITH {RETURNS}, h AS (SELECT tf, CAST(floor(ln(greatest(abs(y), 0.01)) * 50) AS BIGINT) AS bin, count(*) AS n FROM r WHERE y IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY tf ORDER BY bin) AS run, sum(n) OVER (PARTITION BY tf) AS total FROM h)
SELECT tf, min(bin) AS bin FROM c WHERE run >= 0.8 * total GROUP BY tf""")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.8 quantile of moves from a mergeable histogram of logarithmic bins."""
    bins = F.floor(F.log(F.greatest(F.abs("y"), F.lit(0.01))) * 50).cast("long")
    h = returns(spark, sf_dir).where(F.col("y").isNotNull()).groupBy("tf", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tf")
    c = h.withColumns({"run": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("n").over(w)})
    return c.where(F.col("run") >= 0.8 * F.col("total")).groupBy("tf").agg(F.min("bin").alias("bin"))


@query("exact_quantiles", f"WITH {RETURNS} SELECT root, pair, tf, round(quantile_cont(x, 0.1), 6) AS q10, round(median(x), 6) AS q50, round(quantile_cont(x, 0.9), 6) AS q90 FROM r WHERE x IS NOT NULL GROUP BY root, pair, tf")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("x").isNotNull())
    q = P.quantiles(df, SERIES, "x", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, 5.0)
    return q.select(*SERIES, *(F.round(c, 6).alias(c) for c in ("q10", "q50", "q90")))


@query("regression_slope", f"WITH {RETURNS} SELECT root, pair, tf, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(y, x), 6) AS corr FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY root, pair, tf")
def regression_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.corr("y", "x"), 6).alias("corr"))


@query("deciles", f"""WITH {RETURNS}, c AS (SELECT tf, quantile_cont(abs(x), 0.9) AS cut FROM r WHERE x IS NOT NULL AND bar_time < TIMESTAMP '2024-01-01' GROUP BY tf) SELECT tf, count(*) AS n, round(avg(sign(x) * y), 6) AS mean FROM r JOIN c USING (tf) WHERE abs(x) >= cut + 1e-9 AND y IS NOT NULL AND bar_time >= TIMESTAMP '2024-01-01' GROUP BY tf""")
def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top tenth by the earlier period's cut, scored on the later period."""
    df = returns(spark, sf_dir).where(F.col("x").isNotNull()).withColumn("late", F.col("bar_time") >= F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    cuts = P.quantiles(df.where("NOT late").withColumn("size", F.abs("x")), ["tf"], "size", {"cut": 0.9}, 5.0)
    top = df.where("late").where(F.col("y").isNotNull()).join(cuts, "tf").where(F.abs("x") >= F.col("cut") + 1e-9)
    return top.groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.signum("x") * F.col("y")), 6).alias("mean"))


@query("binomial_test")
def binomial_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where((F.abs("x") > 1e-9) & (F.abs("y") > 1e-9))
    s = df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") * F.col("y") > 0).alias("hits"))
    return s.select(*SERIES, "n", "hits", F.round(P.two_sided("hits", "n"), 6).alias("p"))


@query("strength", f"""WITH {RETURNS}, e AS (SELECT root, tf, bar_time, substr(pair, 1, 3) AS cur, x AS v FROM r WHERE x IS NOT NULL UNION ALL SELECT root, tf, bar_time, substr(pair, 4, 3), -x FROM r WHERE x IS NOT NULL)
SELECT root, tf, strftime(bar_time, '%Y-%m-%d %H:%M:%S') AS bar_time, cur, count(*) AS n, round(avg(v), 6) AS strength FROM e GROUP BY root, tf, bar_time, cur""")
def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean move of each currency against the others at each bar."""
    sides = F.array(F.struct(F.substring("pair", 1, 3).alias("cur"), F.col("x").alias("v")), F.struct(F.substring("pair", 4, 3).alias("cur"), (-F.col("x")).alias("v")))
    df = returns(spark, sf_dir).where(F.col("x").isNotNull()).select("root", "tf", "bar_time", F.inline(sides))
    return df.groupBy("root", "tf", "bar_time", "cur").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("strength")).withColumn("bar_time", stamp())


@query("realized_variance", f"""WITH {RETURNS}, v AS (SELECT root, pair, {{day}} AS day, sum(x * x) AS rv, count(*) AS n FROM r WHERE tf = '1h' AND x IS NOT NULL GROUP BY ALL), f AS (SELECT *, min(day) OVER (PARTITION BY root, pair) AS first FROM v)
SELECT root, pair, strftime(day, '%Y-%m-%d') AS day, n, round(rv, 5) AS rv FROM f WHERE day > first""".replace("{day}", "CAST(bar_time AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS DATE) + CAST(CASE isodow(bar_time AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS INTEGER)"))
def realized_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.realised(returns(spark, sf_dir).where("tf = '1h'")).select("root", "pair", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round(F.col("rv"), 5).alias("rv"))


@query("day_measures", f"""WITH {RETURNS}, d AS (SELECT root, pair, CAST(bar_time AS DATE) AS day, count(*) AS n, sum(x * x) AS rv, sum(abs(x)) AS absr, count(*) / 3.0 * sum(x * x * x * x) AS rq, sum(x) AS ret, pow(ln(max(high) / min(low)) * 10000, 2) / (4 * ln(2)) AS park FROM r WHERE tf = '1h' AND x IS NOT NULL GROUP BY ALL)
SELECT root, pair, strftime(day, '%Y-%m-%d') AS day, n, round(rv, 4) AS rv, round(absr, 5) AS absr, round(sqrt(rq), 4) AS rq, round(ret, 5) AS ret, round(park, 4) AS park FROM d""")
def day_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.day_measures(returns(spark, sf_dir).where("tf = '1h'"))
    return d.select("root", "pair", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", *(F.round(F.col(c), k).alias(c) for c, k in (("rv", 4), ("absr", 5), ("rq", 4), ("ret", 5), ("park", 4))))


@query("har_features", f"""WITH {RETURNS}, d AS (SELECT root, pair, CAST(bar_time AS DATE) AS day, sum(x * x) AS rv FROM r WHERE tf = '1h' AND x IS NOT NULL GROUP BY ALL)
SELECT root, pair, strftime(day, '%Y-%m-%d') AS day, round(rv, 4) AS d1, round(CASE WHEN count(*) OVER w5 >= 5 THEN avg(rv) OVER w5 END, 4) AS d5, round(CASE WHEN count(*) OVER w22 >= 22 THEN avg(rv) OVER w22 END, 4) AS d22, round(lead(rv) OVER (PARTITION BY root, pair ORDER BY day), 4) AS target
FROM d WINDOW w5 AS (PARTITION BY root, pair ORDER BY day ROWS 4 PRECEDING), w22 AS (PARTITION BY root, pair ORDER BY day ROWS 21 PRECEDING)""")
def har_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.har(M.day_measures(returns(spark, sf_dir).where("tf = '1h'")))
    return d.select("root", "pair", F.date_format("day", "yyyy-MM-dd").alias("day"), *(F.round(F.col(c), 4).alias(c) for c in ("d1", "d5", "d22", "target")))


@query("parkinson", f"WITH {BARS} SELECT {KEY}, round(CASE WHEN high > low THEN pow(ln(high / low), 2) / (4 * ln(2)) * 100000000 END, 5) AS park FROM bars")
def parkinson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir).withColumn("park", M.parkinson() * 1e8), ["park"], 5)


@query("range_scale", f"""WITH {RETURNS}, p AS (SELECT *, CASE WHEN high > low THEN pow(ln(high / low) * 10000, 2) / (4 * ln(2)) END AS park FROM r), m AS (SELECT *, count(*) FILTER (park IS NOT NULL AND x IS NOT NULL) OVER w AS k, sum(CASE WHEN park IS NOT NULL THEN x * x END) OVER w / nullif(sum(CASE WHEN x IS NOT NULL THEN park END) OVER w, 0) AS ratio FROM p WINDOW w AS ({W} ROWS 249 PRECEDING))
SELECT {KEY}, round(CASE WHEN k >= 50 THEN ln(ratio) END, 6) AS log_ratio FROM m""")
def range_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale of the range variance: mean squared move over mean range variance of the last 250 bars where both are known."""
    return shown(M.range_scale(returns(spark, sf_dir)).withColumn("log_ratio", F.log("ratio")), ["log_ratio"])


@query("ewma_variance", f"""WITH RECURSIVE {RETURNS}, n AS (SELECT root, pair, tf, bar_time, x, row_number() OVER ({W}) AS rn, var_pop(x) OVER ({W} ROWS 499 PRECEDING) AS long FROM r), e AS (SELECT root, pair, tf, bar_time, rn, long, CAST(NULL AS DOUBLE) AS q FROM n WHERE rn = 1
UNION ALL SELECT n.root, n.pair, n.tf, n.bar_time, n.rn, n.long, CASE WHEN e.q IS NULL THEN n.x * n.x ELSE 0.06 * n.x * n.x + 0.94 * e.q END FROM e JOIN n ON n.root = e.root AND n.pair = e.pair AND n.tf = e.tf AND n.rn = e.rn + 1)
SELECT {KEY}, round(CASE WHEN rn >= 21 THEN sqrt(0.9 * q + 0.1 * long) END, 4) AS deviation FROM e""")
def ewma_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(M.ewma_variance(returns(spark, sf_dir)).withColumn("deviation", F.sqrt("variance")), ["deviation"], 4)


SLOT = f"""WITH {RETURNS}, o AS (SELECT r.*, minutes, bar_time AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS ny, lag(bar_time) OVER ({W}) AS p FROM r JOIN timeframes USING (tf) WHERE minutes > 0),
u AS (SELECT *, (isodow(ny) - 1) * (1440 // minutes) + (hour(ny) * 60 + minute(ny)) // minutes AS slot, (hour(ny) * 60 + minute(ny)) // minutes AS tod FROM o
 WHERE x IS NOT NULL AND epoch_us(bar_time) - epoch_us(p) <= minutes::BIGINT * 60000000 AND ((isodow(ny) <= 4) OR (isodow(ny) = 5 AND hour(ny) < 17) OR (isodow(ny) = 7 AND hour(ny) >= 17)))"""


@query("slot_stats", f"{SLOT}, a AS (SELECT root, pair, tf, slot, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM u GROUP BY ALL) SELECT root, pair, tf, slot, n, round(CASE WHEN n >= 5 THEN mean ELSE 0 END, 6) AS mean, round(CASE WHEN n >= 5 AND sd > 0 THEN mean / sd * sqrt(n) ELSE 0 END, 5) AS t FROM a")
def slot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean move and t of each New York weekday-and-time slot, without bars after a pause or in a closed market."""
    s = N.slot_stats(N.slotted(returns(spark, sf_dir), table(spark, sf_dir, "timeframes")), "slot", 5)
    return s.select(*SERIES, "slot", "n", F.round(F.col("mean"), 6).alias("mean"), F.round(F.col("t"), 5).alias("t"))


@query("slot_shrink", f"""{SLOT}, a AS (SELECT root, pair, tf, tod, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM u GROUP BY ALL), b AS (SELECT *, sd / sqrt(n) AS se FROM a WHERE n >= 5 AND sd > 0 AND mean <> 0), c AS (SELECT root, pair, tf, count(*) AS k, greatest(0, avg(mean * mean) - avg(se * se)) AS tau2 FROM b GROUP BY ALL)
SELECT root, pair, tf, tod, round(CASE WHEN k >= 2 THEN tau2 / (tau2 + se * se) ELSE 0 END, 6) AS factor FROM b JOIN c USING (root, pair, tf)""")
def slot_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical-Bayes factor of each time-of-day slot's mean."""
    return N.shrink(N.slot_stats(N.slotted(returns(spark, sf_dir), table(spark, sf_dir, "timeframes")), "tod", 5), "tod").withColumn("factor", F.round(F.col("factor"), 6))


@query("slot_profile", f"""{SLOT}, a AS (SELECT root, pair, tf, tod, count(*) AS n, avg(x * x) AS v FROM u GROUP BY ALL), b AS (SELECT *, max(tod) OVER (PARTITION BY root, pair, tf) AS top FROM a), m AS (SELECT b.*, l.v AS lv, h.v AS hv FROM b JOIN timeframes t USING (tf)
LEFT JOIN a l ON l.root = b.root AND l.pair = b.pair AND l.tf = b.tf AND l.tod = (b.tod + 1440 // minutes - 1) % (1440 // minutes) LEFT JOIN a h ON h.root = b.root AND h.pair = b.pair AND h.tf = b.tf AND h.tod = (b.tod + 1) % (1440 // minutes)),
s AS (SELECT *, 0.5 * v + 0.25 * coalesce(lv, v) + 0.25 * coalesce(hv, v) AS w FROM m) SELECT root, pair, tf, tod, n, round(w / avg(w) OVER (PARTITION BY root, pair, tf), 6) AS profile FROM s""")
def slot_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative variance by time of day, smoothed around the clock, mean 1."""
    frames = table(spark, sf_dir, "timeframes")
    return N.profile(N.slotted(returns(spark, sf_dir), frames)).select(*SERIES, "tod", "n", F.round(F.col("profile"), 6).alias("profile"))


@query("bar_drift", f"""{SLOT}, a AS (SELECT root, pair, tf, slot, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM u GROUP BY ALL), b AS (SELECT root, pair, tf, tod, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM u GROUP BY ALL),
j AS (SELECT u.root, u.pair, u.tf, u.bar_time, CASE WHEN a.n >= 5 AND a.sd > 0 THEN a.mean / a.sd * sqrt(a.n) ELSE 0 END AS tw, a.mean AS mw, CASE WHEN b.n >= 5 AND b.sd > 0 THEN b.mean / b.sd * sqrt(b.n) ELSE 0 END AS td, b.mean AS md FROM u JOIN a USING (root, pair, tf, slot) JOIN b USING (root, pair, tf, tod))
SELECT {KEY}, round(CASE WHEN abs(tw) >= 2 THEN mw WHEN abs(td) >= 2 THEN md ELSE 0 END, 6) AS drift FROM j""")
def bar_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected move of each bar: its weekday-and-time slot where clear, else its time of day."""
    return shown(N.drift(N.slotted(returns(spark, sf_dir), table(spark, sf_dir, "timeframes")), 5), ["drift"])


@query("trade_settle", f"""WITH {BARS}, a AS (SELECT *, row_number() OVER ({W}) AS n, avg(high - low) OVER ({W} ROWS 13 PRECEDING) AS atr FROM bars WHERE tf = '1d'), e AS (SELECT *, CASE WHEN close >= lag(close, 5) OVER ({W}) THEN 1 ELSE -1 END AS d FROM a QUALIFY n > 14),
m AS (SELECT e.root, e.pair, e.tf, e.bar_time, e.d, e.close AS entry, e.close - e.d * 2 * e.atr AS sl, e.close + e.d * 2 * e.atr AS tp, b.n - e.n AS k, b.open, b.high, b.low, b.close AS c, b.n AS bn FROM e JOIN a b ON b.root = e.root AND b.pair = e.pair AND b.n BETWEEN e.n + 1 AND e.n + 5),
x AS (SELECT *, CASE WHEN d * (open - sl) <= 0 THEN open WHEN d * (open - tp) >= 0 THEN open WHEN d * ((CASE WHEN d > 0 THEN low ELSE high END) - sl) <= 0 THEN sl WHEN d * ((CASE WHEN d > 0 THEN high ELSE low END) - tp) >= 0 THEN tp WHEN k = 5 THEN c END AS px,
 CASE WHEN d * (open - sl) <= 0 THEN 'sl' WHEN d * (open - tp) >= 0 THEN 'tp' WHEN d * ((CASE WHEN d > 0 THEN low ELSE high END) - sl) <= 0 THEN 'sl' WHEN d * ((CASE WHEN d > 0 THEN high ELSE low END) - tp) >= 0 THEN 'tp' WHEN k = 5 THEN 'time' END AS how FROM m)
SELECT {KEY}, arg_min(how, k) AS how, min(k) AS bars, round(arg_min(d * (px - entry), k) / arg_min(abs(entry - sl), k), 5) AS r FROM x WHERE px IS NOT NULL GROUP BY root, pair, tf, bar_time""")
def trade_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a trade from each daily bar: stop before target within a bar, gaps fill at the open, out after five bars."""
    return T.settled(T.entries(bars_of(spark, sf_dir).where("tf = '1d'"))).select(*SERIES, stamp(), "how", F.col("bars").cast("long").alias("bars"), F.round(F.col("r"), 5).alias("r"))


SETTLED = f"""{BARS}, a AS (SELECT *, row_number() OVER ({W}) AS n, avg(high - low) OVER ({W} ROWS 13 PRECEDING) AS atr FROM bars WHERE tf = '1d'), e0 AS (SELECT *, CASE WHEN close >= lag(close, 5) OVER ({W}) THEN 1 ELSE -1 END AS d FROM a QUALIFY n > 14), e AS (SELECT * FROM e0, (SELECT unnest({{widths}}) AS width), (SELECT unnest({{holds}}) AS hold)),
m AS (SELECT e.root, e.pair, e.tf, e.bar_time, e.n, width, hold, e.d, e.close AS entry, e.close - e.d * width * e.atr AS sl, e.close + e.d * width * e.atr AS tp, b.n - e.n AS k, b.open, b.high, b.low, b.close AS c FROM e JOIN a b ON b.root = e.root AND b.pair = e.pair AND b.n BETWEEN e.n + 1 AND e.n + hold),
x AS (SELECT *, d * (open - sl) <= 0 AS gs, d * (open - tp) >= 0 AS gt, d * ((CASE WHEN d > 0 THEN low ELSE high END) - sl) <= 0 AS st, d * ((CASE WHEN d > 0 THEN high ELSE low END) - tp) >= 0 AS ta FROM m), y AS (SELECT *, CASE WHEN gs OR gt THEN open WHEN st THEN sl WHEN ta THEN tp WHEN k = hold THEN c END AS px, CASE WHEN gs THEN 'sl' WHEN gt THEN 'tp' WHEN st THEN 'sl' WHEN ta THEN 'tp' WHEN k = hold THEN 'time' END AS how FROM x),
s AS (SELECT root, pair, tf, bar_time, n, width, hold, arg_min(how, k) AS how, min(k) AS bars, arg_min(d * (px - entry), k) / arg_min(abs(entry - sl), k) AS r FROM y WHERE px IS NOT NULL GROUP BY ALL)"""


@query("trade_metrics", f"""WITH RECURSIVE {SETTLED.format(widths='[2.0]', holds='[5]')}, nx AS (SELECT s.*, t.n AS nxt FROM s ASOF LEFT JOIN (SELECT root, pair, n FROM s) t ON s.root = t.root AND s.pair = t.pair AND s.n + s.bars <= t.n), f AS (SELECT root, pair, min(n) AS n FROM nx GROUP BY ALL),
kept AS (SELECT nx.* FROM nx JOIN f USING (root, pair, n) UNION ALL SELECT nx.* FROM kept JOIN nx ON nx.root = kept.root AND nx.pair = kept.pair AND nx.n = kept.nxt), c AS (SELECT *, sum(r) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cum FROM kept), g AS (SELECT *, greatest(0, max(cum) OVER ({W} ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM c)
SELECT root, pair, tf, count(*) AS trades, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate, round(avg(r), 4) AS avg_r, round(sum(r), 4) AS total_r, round(sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0), 4) AS profit_factor, count(*) FILTER (how = 'sl') AS by_sl, count(*) FILTER (how = 'tp') AS by_tp, count(*) FILTER (how = 'time') AS by_time, round(max(dd), 4) AS max_drawdown FROM g GROUP BY root, pair, tf""")
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position at a time: the trades kept, their rates and exits."""
    kept = T.one_at_a_time(T.settled(T.entries(bars_of(spark, sf_dir).where("tf = '1d'"))))
    return T.metrics(kept)
