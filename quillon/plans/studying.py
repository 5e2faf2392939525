"""Queries of the composite studies."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions.times import micros
from quillon.operators import bars as B, calendars as C, studies as S, text as X, trades as T, variance as M
from quillon.plans.indicators import DAY_SQL, hourly
from quillon.plans.records import SAID, titles
from quillon.plans.scoring import RETURNS, SETTLED, returns
from quillon.plans.shared import BARS, KEY, Registry, W, bars_of, shown, stamp
from quillon.sources.tables import SERIES, few, small, table

query = Registry()
QUERIES, ORACLE = query.queries, query.sql


@query("walk_forward", f"""WITH {RETURNS}, w AS (SELECT *, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) OVER p AS n, sum(x) FILTER (y IS NOT NULL) OVER p AS sx, sum(y) FILTER (x IS NOT NULL) OVER p AS sy, sum(x * x) FILTER (y IS NOT NULL) OVER p AS sxx, sum(x * y) OVER p AS sxy FROM r WINDOW p AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT {KEY}, n AS trained_on, round(CASE WHEN n >= 30 AND sxx - sx * sx / n > 0 THEN (sxy - sx * sy / n) / (sxx - sx * sx / n) END, 6) AS slope FROM w""")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the next move on the last one, at each bar from the bars whose outcome was known by then."""
    return shown(S.expanding_slope(returns(spark, sf_dir), SERIES, "bar_time", "x", "y", 1, 30), ["trained_on", "slope"])


@query("har_fit")
def har_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heterogeneous autoregression of daily variance per pair."""
    days = M.har(M.day_measures(returns(spark, sf_dir).where("tf = '1h'")))
    fit = S.ols(days, ["pair"], ["d1", "d5", "d22"], "target")
    return fit.select("pair", "n", *(F.round(c, 4).alias(c) for c in ("b_const", "b_d1", "b_d5", "b_d22")))


@query("bootstrap")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("v", F.signum("x") * F.col("y"))
    b = S.bootstrap_mean(df, ["tf"], "v", F.struct("root", "pair", "bar_time"))
    return b.select("tf", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


@query("panel_t", f"""WITH {RETURNS}, v AS (SELECT tf, bar_time, sign(x) * y AS v FROM r WHERE x IS NOT NULL AND y IS NOT NULL), m AS (SELECT tf, avg(v) AS mean, count(*) AS n FROM v GROUP BY tf), s AS (SELECT tf, bar_time, sum(v - mean) AS s, any_value(mean) AS mean, any_value(n) AS n FROM v JOIN m USING (tf) GROUP BY tf, bar_time),
l AS (SELECT *, s * lag(s, 1) OVER o AS c1, s * lag(s, 2) OVER o AS c2 FROM s WINDOW o AS (PARTITION BY tf ORDER BY bar_time)), a AS (SELECT tf, count(*) AS periods, any_value(mean) AS mean, any_value(n) AS n, sum(s * s) + 2 * (1 - 1.0 / 3) * sum(c1) + 2 * (1 - 2.0 / 3) * sum(c2) AS v FROM l GROUP BY tf)
SELECT tf, periods, round(mean * n / sqrt(v), 5) AS t FROM a""")
def panel_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("v", F.signum("x") * F.col("y"))
    return S.panel_t(df, ["tf"], "bar_time", "v", 2).withColumn("t", F.round(F.col("t"), 5))


@query("stories")
def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story of each title: the earliest leading title alike within 12 hours, equal ones included.

    One item per title and second: a title that comes again later is judged, and leads, at its own time.
    """
    at = F.floor(micros(F.col("published_at")) / 1_000_000).cast("long")
    t = titles(spark, sf_dir).where(F.col("published_at").isNotNull()).select("doc_id", "key", at.alias("at"))
    items = t.groupBy("key", "at").agg(F.min("doc_id").alias("id"))
    led = S.leaders(X.story_pairs(items), items, "id", "at")
    return t.join(items, ["key", "at"]).join(led, "id").select("doc_id", "story")


@query("replay_scale")
def replay_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = returns(spark, sf_dir).withColumn("sd", F.stddev_pop("x").over(B.trailing(20))).where((F.col("sd") > 0.01) & F.col("y").isNotNull())
    out = S.replay_scale(df.withColumn("size", F.abs("y") / F.col("sd")), SERIES, "bar_time", "size")
    return shown(out, ["scale"], 5)


@query("logistic_direction")
def logistic_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the next move by a logistic regression fitted before 2024 and scored after."""
    w = B.series_window()
    df = returns(spark, sf_dir).withColumns({"x1": F.lag("x").over(w), "m5": F.avg("x").over(B.trailing(5))})
    df = df.where(F.col("x").isNotNull() & F.col("x1").isNotNull() & F.col("y").isNotNull()).withColumn("label", (F.col("y") > 0).cast("double"))
    parts = VectorAssembler(inputCols=["x", "x1", "m5"], outputCol="features").transform(df)
    early = F.col("bar_time") < F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    model = LogisticRegression(maxIter=25, regParam=0.01).fit(parts.where(early))
    said = model.transform(parts.where(~early)).withColumn("p", F.element_at(vector_to_array("probability"), 2))
    return said.groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("p") > 0.5) == (F.col("label") > 0)).cast("double")), 4).alias("accuracy"))


@query("london_days", f"""WITH {BARS}, g AS (SELECT pair, min(root) AS root FROM bars WHERE tf = '1h' GROUP BY pair), h AS (SELECT pair, {DAY_SQL} AS day, count(*) AS n, arg_max(close, bar_time) AS hc FROM bars JOIN g USING (pair, root) WHERE tf = '1h' GROUP BY ALL),
d AS (SELECT *, lead(open) OVER (PARTITION BY root, pair ORDER BY bar_time) AS nxt FROM bars WHERE tf = '1d'), j AS (SELECT d.root, d.pair, d.tf, d.bar_time, CASE WHEN n >= 12 THEN hc ELSE coalesce(nxt, close) END AS c, open, high, low FROM d LEFT JOIN h ON h.pair = d.pair AND h.day = d.bar_time)
SELECT {KEY}, c AS close, greatest(high, c) AS high, least(low, c) AS low FROM j""")
def london_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars whose close is rebuilt from at least 12 hourly bars, else taken from the next day's open.

    No root has both kinds of a pair, so the hourly bars are those of the pair's first root that has any.
    """
    bars = bars_of(spark, sf_dir)
    day = B.trading_day(B.in_zone(F.col("bar_time"), B.LONDON))
    hours = bars.where("tf = '1h'")
    hours = hours.join(hours.groupBy("pair").agg(F.min("root").alias("root")), ["pair", "root"])
    built = B.bucketed(hours, ["pair"], "bar_time", day, 12).select("pair", F.col("bucket").alias("day"), F.col("close").alias("rebuilt"))
    daily = bars.where("tf = '1d'").withColumns({"nxt": F.lead("open").over(B.series_window()), "day": F.to_date("bar_time")})
    j = daily.join(built, ["pair", "day"], "left").withColumn("close", F.coalesce("rebuilt", "nxt", "close"))
    return j.select(*SERIES, stamp(), "close", F.greatest("high", "close").alias("high"), F.least("low", "close").alias("low"))


@query("intra_rv", f"""WITH {RETURNS} SELECT root, pair, strftime(date_trunc('hour', bar_time), '%Y-%m-%d %H:%M:%S') AS hour, CASE WHEN count(x) >= 4 THEN round(sum(x * x), 5) END AS rv FROM r WHERE tf = '15m' GROUP BY root, pair, date_trunc('hour', bar_time)""")
def intra_rv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance within each hour from its 15-minute moves, only where all four are known."""
    q = returns(spark, sf_dir).where("tf = '15m'").groupBy("root", "pair", F.date_trunc("hour", "bar_time").alias("hour"))
    return q.agg(F.when(F.count("x") >= 4, F.round(F.sum(F.col("x") * F.col("x")), 5)).alias("rv")).withColumn("hour", stamp("hour"))


@query("same_trades", f"""WITH {BARS}, s AS (SELECT *, close > avg(close) OVER ({W} ROWS 19 PRECEDING) + 1e-9 AS a, close > lag(close, 10) OVER ({W}) AS b FROM bars WHERE tf = '1d') SELECT pair, count(*) FILTER (a) AS first, count(*) FILTER (b) AS second, count(*) FILTER (a AND b) AS common FROM s GROUP BY pair""")
def same_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries two rules have in common."""
    w = B.series_window()
    df = bars_of(spark, sf_dir).where("tf = '1d'").withColumns({"a": F.col("close") > F.avg("close").over(B.trailing(20)) + 1e-9, "b": F.coalesce(F.col("close") > F.lag("close", 10).over(w), F.lit(False))})
    return df.groupBy("pair").agg(F.count_if("a").alias("first"), F.count_if("b").alias("second"), F.count_if(F.col("a") & F.col("b")).alias("common"))


@query("monthly_curve", f"""WITH {RETURNS}, m AS (SELECT tf, date_trunc('month', bar_time) AS month, sum(sign(x) * y) AS v FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), e AS (SELECT tf, min(month) AS a, max(month) AS z FROM m GROUP BY tf), c AS (SELECT tf, unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS month FROM e)
SELECT tf, strftime(month, '%Y-%m') AS month, round(sum(coalesce(v, 0)) OVER (PARTITION BY tf ORDER BY month), 5) AS total FROM c LEFT JOIN m USING (tf, month)""")
def monthly_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total by month, months without trades included."""
    m = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("tf", F.trunc("bar_time", "month").alias("month")).agg(F.sum(F.signum("x") * F.col("y")).alias("v"))
    ends = m.groupBy("tf").agg(F.min("month").alias("a"), F.max("month").alias("z"))
    grid = ends.select("tf", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    w = Window.partitionBy("tf").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(m, ["tf", "month"], "left").select("tf", F.date_format("month", "yyyy-MM").alias("month"), F.round(F.sum(F.coalesce("v", F.lit(0.0))).over(w), 5).alias("total"))


@query("rule_grid", f"""WITH {SETTLED.format(widths='[1.0, 2.0, 3.0]', holds='[5, 10]')}, q AS (SELECT CAST(width AS DOUBLE) AS width, hold, bar_time < TIMESTAMP '2024-01-01' AS tune, r FROM s), g AS (SELECT width, hold, tune, count(*) AS n, round(avg(r), 4) AS mean_r, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 3) AS t FROM q GROUP BY ALL)
SELECT *, tune AND row_number() OVER (PARTITION BY tune ORDER BY t DESC NULLS LAST, width, hold) = 1 AS chosen FROM g""")
def rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stop width and holding period: trades and mean result before 2024, and the choice by its t."""
    daily = bars_of(spark, sf_dir).where("tf = '1d'")
    grid = [(width, hold) for width in (1.0, 2.0, 3.0) for hold in (5, 10)]
    done = T.settled(T.unfolded(T.entries(daily, 1.0, 10), grid), "width")
    out = done.select("r", "width", "hold", (F.col("bar_time") < F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).alias("tune"))
    s = out.groupBy("width", "hold", "tune").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 4).alias("mean_r"), F.round(F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * F.sqrt(F.count(F.lit(1))), 3).alias("t"))
    best = F.first(F.struct("width", "hold")).over(Window.partitionBy("tune").orderBy(F.col("t").desc_nulls_last(), "width", "hold"))
    return s.withColumn("chosen", F.col("tune") & (best == F.struct("width", "hold")))


@query("trading_grid", """WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31 23:59:59', INTERVAL 1 HOUR)) AS slot), n AS (SELECT slot, slot AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS ny FROM s)
SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, row_number() OVER (ORDER BY slot) AS seq FROM n WHERE (isodow(ny) <= 4) OR (isodow(ny) = 5 AND hour(ny) < 17) OR (isodow(ny) = 7 AND hour(ny) >= 17)""")
def trading_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-market hours of a year, numbered."""
    return C.trading_grid(spark, "2024-01-01", "2024-12-31", 60).select(stamp("slot"), "seq")


GRID = """e AS (SELECT date_trunc('day', min(bar_time)) AS a, date_trunc('day', max(bar_time)) + INTERVAL 9 DAY AS z FROM bars WHERE tf = '1h'), s AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS slot FROM e), ny AS (SELECT slot, slot AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS ny FROM s),
grid AS (SELECT slot, row_number() OVER (ORDER BY slot) AS seq FROM ny WHERE (isodow(ny) <= 4) OR (isodow(ny) = 5 AND hour(ny) < 17) OR (isodow(ny) = 7 AND hour(ny) >= 17))"""


@query("bar_targets", f"""WITH {BARS}, {GRID} SELECT {KEY}, strftime(t.slot + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS target FROM bars JOIN grid g ON g.slot = bar_time + INTERVAL 1 HOUR JOIN grid t ON t.seq = g.seq + 3 WHERE tf = '1h'""")
def bar_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of the fourth open-market hour after each hourly bar's end: two equal joins on the numbered grid."""
    bars = bars_of(spark, sf_dir).where("tf = '1h'").withColumn("slot", F.timestamp_add("HOUR", F.lit(1), F.col("bar_time")))
    grid = C.trading_slots(bars.agg(F.to_date(F.min("slot")).alias("first"), F.date_add(F.to_date(F.max("slot")), 7).alias("last")), 60)
    ends = grid.select((F.col("seq") - 3).alias("seq"), F.timestamp_add("HOUR", F.lit(1), F.col("slot")).alias("target"))
    return bars.join(grid, "slot").join(ends, "seq").select(*SERIES, stamp(), stamp("target"))


def daily_years(daily: DataFrame) -> range:
    """The years that the daily bars lie in."""
    span = daily.agg(F.min(F.year("bar_time")).alias("a"), F.max(F.year("bar_time")).alias("z")).first()
    return range(span.a, span.z + 1) if span.a is not None else range(2024, 2025)


@query("holidays")
def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank holidays of each currency in the years of the daily bars and the one after, into which value dates reach."""
    years = daily_years(bars_of(spark, sf_dir).where("tf = '1d'"))
    return C.holiday_table(spark, range(years[0], years[-1] + 2))


@query("spot_dates")
def spot_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value dates of each daily bar; null where a currency has no calendar. USDCAD also by the next-day rule."""
    daily = bars_of(spark, sf_dir).where("tf = '1d'").withColumn("day", F.to_date("bar_time"))
    pairs = [(r.base, r.quote) for r in few(table(spark, sf_dir, "fx_pairs").where(F.col("base").isin(*C.RULES) & F.col("quote").isin(*C.RULES)).select("base", "quote").distinct())]
    dates = small(C.spot_table(spark, pairs, daily_years(daily)), 100_000)
    written = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return daily.join(dates, ["pair", "day"], "left").select("root", "pair", written("day"), written("spot"), "roll_days", written("spot_t1"), "roll_days_t1")


@query("gbt_direction")
def gbt_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the next daily move by boosted trees fitted before 2024 and scored after."""
    w = B.series_window()
    df = returns(spark, sf_dir).where("tf = '1d'").withColumns({"x1": F.lag("x").over(w), "m5": F.avg("x").over(B.trailing(5)), "sd": F.stddev_pop("x").over(B.trailing(20))})
    df = df.where("x IS NOT NULL AND x1 IS NOT NULL AND y IS NOT NULL AND sd IS NOT NULL").withColumn("label", (F.col("y") > 0).cast("double"))
    parts = VectorAssembler(inputCols=["x", "x1", "m5", "sd"], outputCol="features").transform(df)
    early = F.col("bar_time") < F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    said = GBTClassifier(maxIter=10, maxDepth=3, seed=1).fit(parts.where(early)).transform(parts.where(~early))
    return said.groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))


@query("currency_days", f"""WITH {SAID}, e AS (SELECT cur, v, date_trunc('day', published_at) AS h FROM s WHERE published_at IS NOT NULL), g AS (SELECT h, cur, count(*) AS n, avg(round(tanh(v / 1.5), 3)) AS tone FROM e GROUP BY ALL)
SELECT strftime(h, '%Y-%m-%d') AS day, cur, n, round(tone, 6) AS tone, round(n / sum(n) OVER (PARTITION BY h), 6) AS share FROM g""")
def currency_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's headlines by currency: number, mean score and share of all of the day."""
    d = table(spark, sf_dir, "documents").where(F.col("published_at").isNotNull())
    e = X.scores(d).join(d.select("doc_id", F.date_trunc("day", "published_at").alias("h")), "doc_id")
    g = e.groupBy("h", "cur").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("tone"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("h"))
    return g.select(F.date_format("h", "yyyy-MM-dd").alias("day"), "cur", "n", F.round("tone", 6).alias("tone"), F.round(share, 6).alias("share"))


@query("candle_stats", f"""WITH {RETURNS}, c AS (SELECT tf, close > open AS up, lead(close > open) OVER ({W}) AS nxt, high - low AS size, avg(high - low) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS said FROM r) SELECT tf, count(*) AS n, round(avg(CASE WHEN up = nxt THEN 1.0 ELSE 0.0 END), 6) AS colour, round(avg(abs(size - said) / said), 6) AS size_error FROM c WHERE nxt IS NOT NULL AND said > 1e-9 GROUP BY tf""")
def candle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a candle has the colour of the one before, and how far its size is from the mean of fourteen."""
    w = B.series_window()
    df = bars_of(spark, sf_dir).withColumns({"up": F.col("close") > F.col("open"), "size": F.col("high") - F.col("low")})
    df = df.withColumns({"nxt": F.lead("up").over(w), "said": F.avg("size").over(w.rowsBetween(-14, -1))}).where(F.col("nxt").isNotNull() & (F.col("said") > 1e-9))
    same, err = (F.col("up") == F.col("nxt")).cast("double"), F.abs(F.col("size") - F.col("said")) / F.col("said")
    return df.groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("colour"), F.round(F.avg(err), 6).alias("size_error"))
