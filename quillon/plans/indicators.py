"""Queries over bars: cleaning, bucketing, rolling and recursive indicators, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators import bars as B, recursive as R, signals as S, windows as V
from quillon.plans.shared import BARS, KEY, Registry, W, bars_of, rounded, shown, stamp
from quillon.sources.tables import SERIES, plain_pair, small, table

query = Registry()
QUERIES, ORACLE = query.queries, query.sql


@query("fix_ohlc", f"WITH {BARS} SELECT {KEY}, open, high, low, close FROM bars")
def fix_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir), ["open", "high", "low", "close"], 9)


@query("dedupe_keep_last", f"""WITH v AS (SELECT line_id, row_number() OVER (PARTITION BY root, upper(replace(replace(pair, '/', ''), '_', '')), tf, bar_time ORDER BY fetched_at DESC, line_id DESC) AS k FROM prices)
SELECT line_id FROM v WHERE k = 1""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prices").groupBy("root", plain_pair(F.col("pair")).alias("pair"), "tf", "bar_time").agg(F.max_by("line_id", F.struct("fetched_at", "line_id")).alias("line_id")).select("line_id")


@query("market_open_filter", f"""WITH {BARS}, t AS (SELECT *, bar_time AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS ny FROM bars WHERE tf <> '1d')
SELECT {KEY} FROM t WHERE (isodow(ny) <= 4) OR (isodow(ny) = 5 AND hour(ny) < 17) OR (isodow(ny) = 7 AND hour(ny) >= 17)""")
def market_open_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir).where((F.col("tf") != "1d") & B.market_open(F.col("bar_time"))), [])


@query("completed_bars", """SELECT line_id, strftime(done, '%Y-%m-%d %H:%M:%S') AS bar_end FROM (SELECT line_id, fetched_at,
  CASE WHEN minutes > 0 THEN bar_time + minutes * INTERVAL 1 MINUTE
  ELSE ((CAST(bar_time AS DATE) + 1)::TIMESTAMP AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC' END AS done FROM prices JOIN timeframes USING (tf))
WHERE done + INTERVAL 3 MINUTE <= fetched_at""")
def completed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that were complete, with three minutes to settle, when they were stored."""
    minutes = small(table(spark, sf_dir, "timeframes").select("tf", "minutes"))
    ended = table(spark, sf_dir, "prices").join(minutes, "tf").withColumn("bar_end", B.bar_end(F.col("minutes")))
    return ended.where(F.col("bar_end") + F.expr("INTERVAL 3 MINUTES") <= F.col("fetched_at")).select("line_id", stamp("bar_end"))


BUCKET_SQL = """WITH {bars}, t AS (SELECT root, pair, {bucket} AS bucket, bar_time, open, high, low, close FROM bars WHERE tf = '1h')
SELECT root, pair, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, arg_min(open, bar_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_time) AS close, count(*) AS bars
FROM t GROUP BY root, pair, t.bucket HAVING count(*) >= {least}"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark, sf_dir).where(F.col("tf") == "1h")


@query("bars_4h", BUCKET_SQL.format(bars=BARS, bucket="time_bucket(INTERVAL 4 HOUR, bar_time AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London', TIMESTAMP '2000-01-01')", least=1))
def bars_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-hour bars on the London clock."""
    local = B.in_zone(F.col("bar_time"), B.LONDON)
    bucket = F.make_timestamp_ntz(F.year(local), F.month(local), F.day(local), F.floor(F.hour(local) / 4).cast("int") * 4, F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return B.bucketed(hourly(spark, sf_dir), ["root", "pair"], "bar_time", bucket).withColumn("bucket", stamp("bucket"))


DAY_SQL = "CAST(CAST(bar_time AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS DATE) + CASE isodow(bar_time AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS TIMESTAMP)"


@query("bars_1d_london", BUCKET_SQL.format(bars=BARS, bucket=DAY_SQL, least=12))
def bars_1d_london(spark: SparkSession, sf_dir: str) -> DataFrame:
    """London trading days of at least 12 hourly bars; the Sunday evening belongs to Monday."""
    day = B.trading_day(B.in_zone(F.col("bar_time"), B.LONDON)).cast("timestamp_ntz")
    return B.bucketed(hourly(spark, sf_dir), ["root", "pair"], "bar_time", day, 12).withColumn("bucket", stamp("bucket"))


@query("bars_1w", f"""WITH {BARS} SELECT root, pair, strftime(date_trunc('week', bar_time), '%Y-%m-%d') AS week, arg_min(open, bar_time) AS open, max(high) AS high, min(low) AS low,
arg_max(close, bar_time) AS close, count(*) AS bars FROM bars WHERE tf = '1d' GROUP BY root, pair, date_trunc('week', bar_time)""")
def bars_1w(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "bar_time"), "yyyy-MM-dd")
    daily = bars_of(spark, sf_dir).where((F.col("tf") == "1d"))
    return B.bucketed(daily, ["root", "pair"], "bar_time", week).withColumnRenamed("bucket", "week")


@query("tick_bars", """SELECT event_type, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY event_type, time_bucket(INTERVAL 15 MINUTE, ts)""")
def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(F.minute("ts") / 15).cast("int") * 15
    bucket = F.make_timestamp_ntz(F.year("ts"), F.month("ts"), F.day("ts"), F.hour("ts"), minute, F.lit(0).cast("decimal(8,6)"))
    return B.ticks_to_bars(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id", bucket).withColumn("bucket", stamp("bucket"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars without the prices that closes alone don't need: what goes through Python isn't pruned by the planner."""
    return bars_of(spark, sf_dir).select(*SERIES, "bar_time", "close")


def rows(n: int, lag: int = 0) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {lag} PRECEDING)" if lag else f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gate(expr: str, n: int, lag: int = 0) -> str:
    return f"CASE WHEN count(close) {rows(n, lag)} >= {n} THEN {expr} {rows(n, lag)} END"


@query("sma", f"WITH {BARS} SELECT {KEY}, {rounded({f'sma{n}': gate('avg(close)', n) for n in (20, 75, 200)}, 9)} FROM bars")
def sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir).withColumns({f"sma{n}": V.sma("close", n) for n in (20, 75, 200)}), ["sma20", "sma75", "sma200"], 9)


BB_SQL = f"bb AS (SELECT *, {gate('avg(close)', 20)} AS mid, {gate('stddev_pop(close)', 20)} AS sd FROM bars)"


@query("bollinger", f"WITH {BARS}, {BB_SQL} SELECT {KEY}, round(mid - 2 * sd, 6) AS bb_lower, round(mid, 9) AS bb_mid, round(mid + 2 * sd, 6) AS bb_upper FROM bb")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir).withColumns(V.bollinger("close")), ["bb_lower", "bb_mid", "bb_upper"], {"bb_mid": 9})


@query("donchian", f"WITH {BARS} SELECT {KEY}, {rounded({'don_high': gate('max(high)', 20, 1), 'don_low': gate('min(low)', 20, 1)})} FROM bars")
def donchian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir).withColumns(V.donchian()), ["don_high", "don_low"])


RANGE_SQL = f"rg AS (SELECT *, {gate('max(high)', 14)} AS hh, {gate('min(low)', 14)} AS ll FROM bars)"


@query("williams_r", f"WITH {BARS}, {RANGE_SQL} SELECT {KEY}, round(CASE WHEN hh IS NULL THEN NULL WHEN hh > ll THEN -100 * (hh - close) / (hh - ll) ELSE -50 END, 6) AS williams_r FROM rg")
def williams_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir).withColumn("williams_r", V.williams_r()), ["williams_r"])


@query("stochastic", f"""WITH {BARS}, {RANGE_SQL}, s0 AS (SELECT *, CASE WHEN hh IS NULL THEN NULL WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) ELSE 50 END AS raw FROM rg),
s1 AS (SELECT *, CASE WHEN count(raw) {rows(3)} >= 3 THEN avg(raw) {rows(3)} END AS k FROM s0), s2 AS (SELECT *, CASE WHEN count(k) {rows(3)} >= 3 THEN avg(k) {rows(3)} END AS d FROM s1)
SELECT {KEY}, round(k, 6) AS stoch_k, round(d, 6) AS stoch_d FROM s2""")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.stochastic(bars_of(spark, sf_dir)), ["stoch_k", "stoch_d"])


@query("roc", f"WITH {BARS} SELECT {KEY}, round(100 * (close / lag(close, 12) OVER ({W}) - 1), 6) AS roc12 FROM bars")
def roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir).withColumn("roc12", V.roc(12)), ["roc12"])


def mid_sql(n: int) -> str:
    return f"({gate('max(high)', n)} + {gate('min(low)', n)}) / 2"


@query("ichimoku", f"WITH {BARS}, i AS (SELECT *, {mid_sql(9)} AS t, {mid_sql(26)} AS k, {mid_sql(52)} AS b FROM bars) SELECT {KEY}, round(t, 9) AS tenkan, round(k, 9) AS kijun, round((t + k) / 2, 9) AS span_a, round(b, 9) AS span_b FROM i")
def ichimoku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bars_of(spark, sf_dir).withColumns(V.ichimoku()), ["tenkan", "kijun", "span_a", "span_b"], 9)


@query("cci", f"""WITH {BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), m AS (SELECT *, CASE WHEN count(tp) {rows(20)} >= 20 THEN avg(tp) {rows(20)} END AS mean, list(tp) {rows(20)} AS held FROM t),
d AS (SELECT *, list_sum(list_transform(held, lambda x: abs(x - mean))) / 20 AS md FROM m) SELECT {KEY}, round(CASE WHEN md > 1e-12 THEN (tp - mean) / (0.015 * md) END, 5) AS cci FROM d""")
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars_of(spark, sf_dir).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return shown(df.withColumn("cci", V.cci()), ["cci"], 5)


PIVOT_SQL = "p AS (SELECT *, (h + l + c) / 3 AS p FROM q) SELECT {key}, round(p, 6) AS pivot, round(2 * p - l, 6) AS r1, round(2 * p - h, 6) AS s1, round(p + h - l, 6) AS r2, round(p - (h - l), 6) AS s2, round(h + 2 * (p - l), 6) AS r3, round(l - 2 * (h - p), 6) AS s3 FROM p"


@query("pivots", f"WITH {BARS}, q AS (SELECT *, lag(high) OVER ({W}) AS h, lag(low) OVER ({W}) AS l, lag(close) OVER ({W}) AS c FROM bars WHERE tf = '1d'), " + PIVOT_SQL.format(key=KEY))
def pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the previous daily bar."""
    w = B.series_window()
    df = bars_of(spark, sf_dir).where(F.col("tf") == "1d").withColumns({f"_{c}": F.lag(c).over(w) for c in ("high", "low", "close")})
    names = V.pivots(F.col("_high"), F.col("_low"), F.col("_close"))
    return shown(df.withColumns(names), list(names))


@query("pivots_intraday", f"""WITH {BARS}, t AS (SELECT *, {DAY_SQL} AS day FROM bars WHERE tf = '1h'), d AS (SELECT root, pair, day, max(high) AS h, min(low) AS l, arg_max(close, bar_time) AS c FROM t GROUP BY ALL),
e AS (SELECT root, pair, day, lag(h) OVER (PARTITION BY root, pair ORDER BY day) AS h, lag(l) OVER (PARTITION BY root, pair ORDER BY day) AS l, lag(c) OVER (PARTITION BY root, pair ORDER BY day) AS c FROM d),
q AS (SELECT t.root, t.pair, t.tf, t.bar_time, e.h, e.l, e.c FROM t JOIN e USING (root, pair, day)), """ + PIVOT_SQL.format(key=KEY))
def pivots_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hourly bars, from the previous London trading day."""
    df = hourly(spark, sf_dir).withColumn("day", B.trading_day(B.in_zone(F.col("bar_time"), B.LONDON)))
    return shown(S.previous_day_pivots(df), ["pivot", "r1", "s1", "r2", "s2", "r3", "s3"])


RN = f"x AS (SELECT *, row_number() OVER ({W}) AS rn, lag(close) OVER ({W}) AS pc, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl FROM bars)"
SAME = "x.root = r.root AND x.pair = r.pair AND x.tf = r.tf AND x.rn = r.rn + 1"


@query("ema", f"""WITH RECURSIVE {BARS}, {RN}, r AS (SELECT root, pair, tf, bar_time, rn, close AS a, close AS b FROM x WHERE rn = 1
UNION ALL SELECT x.root, x.pair, x.tf, x.bar_time, x.rn, 2.0 / 13 * x.close + 11.0 / 13 * r.a, 2.0 / 27 * x.close + 25.0 / 27 * r.b FROM r JOIN x ON {SAME})
SELECT {KEY}, round(CASE WHEN rn >= 12 THEN a END, 6) AS ema12, round(CASE WHEN rn >= 26 THEN b END, 6) AS ema26 FROM r""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = R.exponential(closes(spark, sf_dir), {"ema12": ("close", 2 / 13, 12), "ema26": ("close", 2 / 27, 26)})
    return shown(df, ["ema12", "ema26"])


@query("macd", f"""WITH RECURSIVE {BARS}, {RN}, r AS (SELECT root, pair, tf, bar_time, rn, close AS a, close AS b, CAST(NULL AS DOUBLE) AS s FROM x WHERE rn = 1
UNION ALL SELECT root, pair, tf, bar_time, rn, na, nb, CASE WHEN rn < 26 THEN NULL WHEN s IS NULL THEN na - nb ELSE 0.2 * (na - nb) + 0.8 * s END FROM
(SELECT x.root, x.pair, x.tf, x.bar_time, x.rn, 2.0 / 13 * x.close + 11.0 / 13 * r.a AS na, 2.0 / 27 * x.close + 25.0 / 27 * r.b AS nb, r.s FROM r JOIN x ON {SAME}))
SELECT {KEY}, round(CASE WHEN rn >= 26 THEN a - b END, 6) AS macd, round(CASE WHEN rn >= 34 THEN s END, 6) AS macd_signal, round(CASE WHEN rn >= 34 THEN a - b - s END, 6) AS macd_hist FROM r""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.macd(closes(spark, sf_dir)), ["macd", "macd_signal", "macd_hist"])


WILDER_SQL = f"""WITH RECURSIVE {BARS}, {RN}, y AS (SELECT *, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
 CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM x),
r AS (SELECT root, pair, tf, bar_time, rn, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS s, tr AS atr, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS adx, 0 AS nd FROM y WHERE rn = 1
UNION ALL SELECT root, pair, tf, bar_time, rn, g, s, atr, t, p, m, CASE WHEN dx IS NULL THEN adx WHEN adx IS NULL THEN dx ELSE dx / 14 + adx * 13 / 14 END, nd + CASE WHEN dx IS NULL THEN 0 ELSE 1 END FROM
(SELECT *, CASE WHEN rn >= 15 AND t > 0 AND p + m > 0 THEN 100 * abs(p - m) / (p + m) END AS dx FROM
(SELECT x.root, x.pair, x.tf, x.bar_time, x.rn, CASE WHEN x.rn = 2 THEN x.gain ELSE x.gain / 14 + r.g * 13 / 14 END AS g, CASE WHEN x.rn = 2 THEN x.loss ELSE x.loss / 14 + r.s * 13 / 14 END AS s,
 x.tr / 14 + r.atr * 13 / 14 AS atr, CASE WHEN x.rn = 2 THEN x.tr ELSE x.tr / 14 + r.t * 13 / 14 END AS t, CASE WHEN x.rn = 2 THEN x.pdm ELSE x.pdm / 14 + r.p * 13 / 14 END AS p,
 CASE WHEN x.rn = 2 THEN x.mdm ELSE x.mdm / 14 + r.m * 13 / 14 END AS m, r.adx, r.nd FROM r JOIN y x ON {SAME})))
"""


@query("rsi", WILDER_SQL + f"SELECT {KEY}, round(CASE WHEN rn < 15 THEN NULL WHEN s = 0 THEN 100 ELSE 100 - 100 / (1 + g / s) END, 6) AS rsi FROM r")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.rsi(closes(spark, sf_dir)), ["rsi"])


@query("atr", WILDER_SQL + f"SELECT {KEY}, round(CASE WHEN rn >= 14 THEN atr END, 6) AS atr FROM r")
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.atr(bars_of(spark, sf_dir)), ["atr"])


@query("adx", WILDER_SQL + f"""SELECT {KEY}, round(CASE WHEN rn >= 15 AND t > 0 THEN 100 * p / t END, 5) AS plus_di, round(CASE WHEN rn >= 15 AND t > 0 THEN 100 * m / t END, 5) AS minus_di,
round(CASE WHEN nd >= 14 AND rn >= 15 AND t > 0 AND p + m > 0 THEN adx END, 5) AS adx FROM r""")
def adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.adx(bars_of(spark, sf_dir)), ["plus_di", "minus_di", "adx"], 5)


STOP_SQL = f"""z AS (SELECT *, row_number() OVER ({W}) AS rn, lag(close) OVER ({W}) AS pc, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl, lag(high, 2) OVER ({W}) AS ph2, lag(low, 2) OVER ({W}) AS pl2 FROM bars),
sar AS (SELECT root, pair, tf, bar_time, rn, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS best, 0.02::DOUBLE AS speed, NULL::BOOLEAN AS up FROM z WHERE rn = 1
UNION ALL SELECT root, pair, tf, bar_time, rn, CASE WHEN rn = 2 THEN s1 WHEN broken THEN CASE WHEN up THEN greatest(best, high, ph) ELSE least(best, low, pl) END ELSE s1 END,
 CASE WHEN rn = 2 THEN best WHEN broken THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(best, high) ELSE least(best, low) END,
 CASE WHEN rn = 2 OR broken THEN 0.02 WHEN (up AND high > best) OR (NOT up AND low < best) THEN least(speed + 0.02, 0.2) ELSE speed END, CASE WHEN rn > 2 AND broken THEN NOT up ELSE up END FROM
 (SELECT *, CASE WHEN up THEN low < s1 ELSE high > s1 END AS broken FROM (SELECT root, pair, tf, bar_time, rn, high, low, ph, pl, speed, up,
  CASE WHEN rn > 2 THEN best WHEN up THEN greatest(high, ph) ELSE least(low, pl) END AS best,
  CASE WHEN rn = 2 THEN CASE WHEN up THEN least(low, pl) ELSE greatest(high, ph) END WHEN up THEN least(s + speed * (best - s), pl, pl2) ELSE greatest(s + speed * (best - s), ph, ph2) END AS s1 FROM
  (SELECT z.root, z.pair, z.tf, z.bar_time, z.rn, z.high, z.low, z.ph, z.pl, z.ph2, z.pl2, sar.s, sar.best, sar.speed, CASE WHEN z.rn = 2 THEN z.close >= z.pc ELSE sar.up END AS up
   FROM sar JOIN z ON z.root = sar.root AND z.pair = sar.pair AND z.tf = sar.tf AND z.rn = sar.rn + 1))))"""
TREND = "CASE WHEN rn > 1 THEN CASE WHEN up THEN 1 ELSE -1 END ELSE 0 END"


@query("parabolic_sar", f"WITH RECURSIVE {BARS}, {STOP_SQL} SELECT {KEY}, round(s, 6) AS psar, {TREND} AS psar_trend FROM sar")
def parabolic_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.parabolic(bars_of(spark, sf_dir)), ["psar", "psar_trend"])


def over_window(expr: str, column: str, n: int) -> str:
    return f"CASE WHEN count({column}) {rows(n)} >= {n} THEN {expr} {rows(n)} END"


LOCAL_DAY = f"CASE WHEN tf = '1d' THEN CAST(bar_time AS DATE) ELSE {DAY_SQL} END"
MEANS = {f"sma{n}": gate("avg(close)", n) for n in (20, 75, 200)} | {"tenkan": mid_sql(9), "kijun": mid_sql(26), "b52": mid_sql(52), "don_high": gate("max(high)", 20, 1), "don_low": gate("min(low)", 20, 1), "sd20": gate("stddev_pop(close)", 20), "hh": gate("max(high)", 14), "ll": gate("min(low)", 14)}
FRAME_SQL = WILDER_SQL.rstrip() + f""", {STOP_SQL}, e AS (SELECT root, pair, tf, bar_time, rn, close AS a, close AS b, CAST(NULL AS DOUBLE) AS s FROM x WHERE rn = 1
UNION ALL SELECT root, pair, tf, bar_time, rn, na, nb, CASE WHEN rn < 26 THEN NULL WHEN s IS NULL THEN na - nb ELSE 0.2 * (na - nb) + 0.8 * s END FROM
(SELECT x.root, x.pair, x.tf, x.bar_time, x.rn, 2.0 / 13 * x.close + 11.0 / 13 * e.a AS na, 2.0 / 27 * x.close + 25.0 / 27 * e.b AS nb, e.s FROM e JOIN x ON {SAME.replace('r.', 'e.')})),
f0 AS (SELECT *, (high + low + close) / 3 AS tp, {LOCAL_DAY} AS day, lag(close, 26) OVER ({W}) AS close_26, 100 * (close / lag(close, 12) OVER ({W}) - 1) AS roc12, {', '.join(f'{v} AS {k}' for k, v in MEANS.items())} FROM bars),
f1 AS (SELECT *, sma20 - 2 * sd20 AS bb_lower, sma20 + 2 * sd20 AS bb_upper, CASE WHEN hh IS NULL THEN NULL WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) ELSE 50 END AS raw, CASE WHEN hh IS NULL THEN NULL WHEN hh > ll THEN -100 * (hh - close) / (hh - ll) ELSE -50 END AS williams_r,
 CASE WHEN count(tp) {rows(20)} >= 20 THEN avg(tp) {rows(20)} END AS mtp, list(tp) {rows(20)} AS held, lag((tenkan + kijun) / 2, 26) OVER ({W}) AS ca, lag(b52, 26) OVER ({W}) AS cb FROM f0),
f2 AS (SELECT *, {over_window('avg(raw)', 'raw', 3)} AS stoch_k, list_sum(list_transform(held, lambda q: abs(q - mtp))) / 20 AS md FROM f1),
dd AS (SELECT root, pair, tf, day, lag(max(high)) OVER o AS h, lag(min(low)) OVER o AS l, lag(arg_max(close, bar_time)) OVER o AS c FROM f0 GROUP BY root, pair, tf, day WINDOW o AS (PARTITION BY root, pair, tf ORDER BY day)),
f3 AS (SELECT f2.*, {over_window('avg(stoch_k)', 'stoch_k', 3)} AS stoch_d FROM f2),
frame AS (SELECT f3.root, f3.pair, f3.tf, f3.bar_time, open, high, low, close, sma20, sma75, sma200, bb_lower, sma20 AS bb_mid, bb_upper, tenkan, kijun, don_high, don_low, williams_r, roc12, stoch_k, stoch_d, close_26, CASE WHEN md > 1e-12 THEN (tp - mtp) / (0.015 * md) END AS cci,
 CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN greatest(ca, cb) END AS cloud_top, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN least(ca, cb) END AS cloud_bottom, CASE WHEN bb_upper - bb_lower > 0 THEN (close - bb_lower) / (bb_upper - bb_lower) END AS pctb,
 (h + l + c) / 3 AS pivot_point, 2 * (h + l + c) / 3 - l AS r1, 2 * (h + l + c) / 3 - h AS s1, (h + l + c) / 3 + (h - l) AS r2, (h + l + c) / 3 - (h - l) AS s2, h + 2 * ((h + l + c) / 3 - l) AS r3, l - 2 * (h - (h + l + c) / 3) AS s3,
 CASE WHEN e.rn >= 26 THEN e.a - e.b END AS macd, CASE WHEN e.rn >= 34 THEN e.s END AS macd_signal, CASE WHEN e.rn >= 34 THEN e.a - e.b - e.s END AS macd_hist, CASE WHEN r.rn < 15 THEN NULL WHEN r.s = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.s) END AS rsi, CASE WHEN r.rn >= 14 THEN r.atr END AS atr,
 CASE WHEN r.rn >= 15 AND r.t > 0 THEN 100 * r.p / r.t END AS plus_di, CASE WHEN r.rn >= 15 AND r.t > 0 THEN 100 * r.m / r.t END AS minus_di, CASE WHEN r.nd >= 14 AND r.rn >= 15 AND r.t > 0 AND r.p + r.m > 0 THEN r.adx END AS adx, sar.s AS psar, {TREND.replace('rn', 'sar.rn')} AS psar_trend
 FROM f3 JOIN r USING (root, pair, tf, bar_time) JOIN e USING (root, pair, tf, bar_time) JOIN sar USING (root, pair, tf, bar_time) JOIN dd ON dd.root = f3.root AND dd.pair = f3.pair AND dd.tf = f3.tf AND dd.day = f3.day)"""
FRAME_COLUMNS = ["open", "high", "low", "close", "macd", "macd_signal", "macd_hist", "rsi", "atr", "adx", "plus_di", "minus_di", "psar", "sma20", "sma75", "sma200", "bb_lower", "bb_mid", "bb_upper", "tenkan", "kijun", "don_high", "don_low", "williams_r", "cci", "roc12", "stoch_k", "stoch_d", "pivot_point", "r1", "s1", "r2", "s2", "r3", "s3", "cloud_top", "cloud_bottom", "close_26", "pctb"]
# digits of the frame as shown: means and prices at nine, ratios that amplify the last place at five
SHOWN = {c: 5 if c in ("cci", "rsi", "adx", "plus_di", "minus_di", "pctb") else 6 if c in ("bb_lower", "bb_upper", "macd", "macd_signal", "macd_hist", "atr", "psar", "williams_r", "roc12", "stoch_k", "stoch_d") else 9 for c in FRAME_COLUMNS}


@query("indicator_frame", f"{FRAME_SQL} SELECT {KEY}, psar_trend, {', '.join(f'round({c}, {SHOWN[c]}) AS {c}' for c in FRAME_COLUMNS)} FROM frame")
def indicator_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.indicator_frame(bars_of(spark, sf_dir)), [*FRAME_COLUMNS, "psar_trend"], SHOWN)


SIGNALS_SQL = f"""{FRAME_SQL}, g0 AS (SELECT root, pair, tf, bar_time, {', '.join('psar_trend' if c == 'psar_trend' else f'round({c}, {S.PLACES}) AS {c}' for c in S.compared())} FROM frame), g AS (SELECT *, {', '.join(f'lag({c}) OVER ({W}) AS was_{c}' for c in S.lagged())} FROM g0),
signals AS (SELECT root, pair, tf, bar_time, {', '.join(f'{S.verdict(n)} AS s_{n}' for n in S.SIGNALS)} FROM g), said AS (SELECT root, pair, tf, bar_time, ({' + '.join(f's_{n}' for n in S.SIGNALS)}) / {len(S.SIGNALS)} AS score FROM signals),
scored AS (SELECT *, CAST(sign(score) AS INTEGER) * (CASE WHEN abs(score) > 0.1 + 1e-9 THEN 1 ELSE 0 END + CASE WHEN abs(score) > 0.4 - 1e-9 THEN 1 ELSE 0 END) AS level FROM said)"""


@query("signals_25", f"{SIGNALS_SQL} SELECT {KEY}, {', '.join(f's_{n} AS {n}' for n in S.SIGNALS)} FROM signals")
def signals_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.signal_frame(bars_of(spark, sf_dir)), S.SIGNALS)


@query("consensus", f"{SIGNALS_SQL} SELECT {KEY}, round(score, 6) AS score, level FROM scored")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(S.consensus(S.signal_frame(bars_of(spark, sf_dir))), ["score", "level"])


@query("consensus_now", f"{SIGNALS_SQL} SELECT {KEY}, round(score, 6) AS score, level FROM scored QUALIFY row_number() OVER (PARTITION BY root, pair, tf ORDER BY bar_time DESC) = 1")
def consensus_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each series, with its consensus."""
    scored = S.consensus(S.signal_frame(bars_of(spark, sf_dir)))
    last = scored.groupBy(*SERIES).agg(F.max_by(F.struct("bar_time", "score", "level"), "bar_time").alias("v"))
    return shown(last.select(*SERIES, "v.*"), ["score", "level"])


SIMPLE_SQL = f"""s0 AS (SELECT *, {gate('avg(close)', 20)} AS a0, {gate('avg(close)', 75)} AS b0 FROM bars), s AS (SELECT *, round(a0, 9) AS a, round(b0, 9) AS b FROM s0), v AS (SELECT *, lag(a) OVER ({W}) AS pa, lag(b) OVER ({W}) AS pb FROM s)"""


@query("ma_cross", f"""WITH {BARS}, {SIMPLE_SQL} SELECT {KEY}, CASE WHEN close > a THEN 1 WHEN close < a THEN -1 ELSE 0 END AS sma20, CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS ma_20_75,
CASE WHEN a > b AND pa <= pb THEN 1 WHEN a < b AND pa >= pb THEN -1 ELSE 0 END AS ma_20_75_cross FROM v""")
def ma_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars_of(spark, sf_dir).withColumns({"a": F.round(V.sma("close", 20), 9), "b": F.round(V.sma("close", 75), 9)})
    return shown(df.withColumns({"sma20": V.state(F.col("close"), F.col("a")), "ma_20_75": V.state(F.col("a"), F.col("b")), "ma_20_75_cross": V.cross("a", "b")}), ["sma20", "ma_20_75", "ma_20_75_cross"])
