"""Queries of the forecast record: ranges, summaries, learning, samples, events, gate, audit, season, rules and costs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions.times import DAY_US, floor_div, micros
from quillon.operators import bars as B, calendars as K, candles, forecasting as M, joins as J, record as C, season as N, stats as P, text as X, variance as Y, windows as V
from quillon.plans.indicators import FRAME_SQL
from quillon.plans.records import SAID
from quillon.plans.scoring import RETURNS, SLOT, returns
from quillon.plans.shared import BARS, KEY, PAIR, Registry, W, bars_of, shown, stamp
from quillon.sources import synthetic
from quillon.sources.tables import SERIES, few, plain_pair, small, table

query = Registry()
QUERIES, ORACLE = query.queries, query.sql

MODELS = ["m1", "m2", "m3"]
NU = {"15m": 5, "1h": 6, "1d": 10}  # fixed values: degrees of freedom by timeframe
CASES = f"""{RETURNS}, c0 AS (SELECT *, 0.0 AS m1, x AS m2, (ln(close) - ln(lag(close, 5) OVER ({W}))) * 2000 AS m3, y AS a, stddev_pop(x) OVER ({W} ROWS 19 PRECEDING) AS s FROM r),
cases AS (SELECT * FROM c0 WHERE s > 0.01 AND a IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three simple forecasts of the next move, the move and the spread of the last twenty."""
    df = returns(spark, sf_dir).withColumns({"m1": F.lit(0.0), "m2": F.col("x"), "m3": B.log_return_bp(5) / 5, "a": F.col("y"), "s": F.stddev_pop("x").over(B.trailing(20))})
    return df.where((F.col("s") > 0.01) & F.col("a").isNotNull() & F.col("m2").isNotNull() & F.col("m3").isNotNull())


def student_sql(z: str, nu: int) -> str:
    """The same finite series in SQL, cut off as the operator cuts it."""
    t = f"greatest(-{M.EDGE}, least({M.EDGE}, ({z}) / {M.t_unit(nu)!r}))"
    square, sine = f"(1 / (1 + {t} * {t} / {nu}))", f"({t} / sqrt({nu} + {t} * {t}))"
    term, parts = 1.0, []
    for k in range((nu - nu % 2) // 2):
        if k:
            term *= (2 * k) / (2 * k + 1) if nu % 2 else (2 * k - 1) / (2 * k)
        parts.append(f"{term!r} * pow({square}, {k})")
    series = " + ".join(parts)
    body = f"(atan({t} / sqrt({nu})) + {sine} * ({series}) * sqrt({square})) / pi()" if nu % 2 else f"{sine} * ({series}) / 2"
    inside = 2 * float(M.student(M.EDGE, nu)) - 1
    return f"(0.5 + ({body}) / {inside!r})"


def by_tf(value) -> F.Column:
    return F.coalesce(*(F.when(F.col("tf") == tf, value(nu)) for tf, nu in NU.items()))


def by_tf_sql(value) -> str:
    return "CASE tf " + " ".join(f"WHEN '{tf}' THEN {value(nu)}" for tf, nu in NU.items()) + " END"


BLEND = f"{CASES}, b0 AS (SELECT *, 0.2 * m1 + 0.3 * m2 + 0.5 * m3 AS c0, s * 1.1 AS sigma, CASE WHEN m3 > 0 THEN 0.5 WHEN m3 < 0 THEN -0.5 ELSE 0 END AS news FROM cases), blend AS (SELECT *, 0.25 * c0 + 0.04 * news * sigma + 0.01 AS c FROM b0)"


def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cases(spark, sf_dir).withColumn("news", F.signum("m3") * 0.5)
    return df.withColumns(C.blended(MODELS, [0.2, 0.3, 0.5], F.col("s"), 1.1, F.col("news"), 0.04, 0.25, F.lit(0.01)))


@query("combine", f"WITH {BLEND} SELECT {KEY}, round(c0, 6) AS c0, round(sigma, 6) AS sigma, round(c, 6) AS c FROM blend")
def combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend of the models with gain, news tilt and drift, and its calibrated spread."""
    return shown(blend(spark, sf_dir), ["c0", "sigma", "c"])


@query("prob_up", f"WITH {BLEND} SELECT {KEY}, round({by_tf_sql(lambda nu: student_sql('c / sigma', nu))}, 8) AS p FROM blend")
def prob_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a higher price, t-shaped by timeframe."""
    df = blend(spark, sf_dir)
    return shown(df.withColumn("p", by_tf(lambda nu: C.chance_up(F.col("c"), F.col("sigma"), nu))), ["p"], 8)


def band_sql(side: str, level: int, nu: int) -> str:
    return f"close * exp((c {side} {M.student_bands(nu, (level,))[level]!r} * sigma) / 10000)"


FAN = {f"{name}{level}": (side, level) for level in (50, 95) for name, side in (("lo", "-"), ("hi", "+"))}


@query("fan", f"WITH {BLEND} SELECT {KEY}, " + ", ".join(f"round({by_tf_sql(lambda nu, s=s, v=v: band_sql(s, v, nu))}, 8) AS {k}" for k, (s, v) in FAN.items()) + " FROM blend")
def fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at both ends of the central 50 and 95 % ranges."""
    df = blend(spark, sf_dir)
    ends = {k: by_tf(lambda nu, k=k: C.ranges(F.col("close"), F.col("c"), F.col("sigma"), nu, (50, 95))[k]) for k in FAN}
    return shown(df.withColumns(ends), list(FAN), 8)


H20 = (1, 5, 10, 20)


def ahead_sql(h: int) -> str:
    return f"round(sqrt({h} * long + (now - long) * {0.9 * (1 - 0.9**h) / (1 - 0.9)!r}), 6) AS h{h}"


@query("horizon_sigma", f"WITH {RETURNS}, v AS (SELECT *, avg(x * x) OVER ({W} ROWS 19 PRECEDING) AS now, avg(x * x) OVER ({W} ROWS 249 PRECEDING) AS long, count(x) OVER ({W} ROWS 249 PRECEDING) AS k FROM r) SELECT {KEY}, {', '.join(map(ahead_sql, H20))} FROM v WHERE k >= 60")
def horizon_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread at each horizon: the variance of the last bars goes back to that of the last 250 by a tenth a step."""
    square = F.col("x") * F.col("x")
    df = returns(spark, sf_dir).withColumns({"now": F.avg(square).over(B.trailing(20)), "long": F.avg(square).over(B.trailing(250)), "k": F.count("x").over(B.trailing(250))}).where("k >= 60")
    return shown(df.withColumns({f"h{h}": F.sqrt(C.spread_ahead(F.col("now"), F.col("long"), 0.9, h)) for h in H20}), [f"h{h}" for h in H20])


def hit_sql(m: str, least: int) -> str:
    moved = f"abs({m}) > 1e-9 AND abs(a) > 1e-9"
    return f"CASE WHEN count(*) FILTER ({moved}) >= {least} THEN round(avg(CASE WHEN sign({m}) = sign(a) THEN 1.0 ELSE 0.0 END) FILTER ({moved}), 6) END"


@query("summarise_rows", f"WITH {CASES}, e AS (SELECT *, (m1 + m2 + m3) / 3 AS ens FROM cases) SELECT tf, count(*) AS n, " + ", ".join(f"round(avg(pow(({m} - a) / s, 2)), 6) AS mse_z_{m}, round(sqrt(avg(({m} - a) * ({m} - a))), 6) AS rmse_{m}, {hit_sql(m, 5)} AS hit_{m}" for m in MODELS) + f", round(sqrt(avg(a * a)), 6) AS rmse_rw, round(sqrt(avg((ens - a) * (ens - a))), 6) AS ens_rmse, {hit_sql('ens', 1)} AS ens_hit, round(avg(CASE WHEN abs(ens - a) / s <= 1.2816 THEN 1.0 ELSE 0.0 END), 6) AS cover80, round(sum(ens * ens / (s * s)), 4) AS suu, round(sum(ens * a / (s * s)), 4) AS suv, round(quantile_cont(abs(ens - a) / s, 0.8) / 1.2816, 6) AS k FROM e GROUP BY tf")
def summarise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three forecasts and their mean: what learning starts from."""
    s = C.summaries(cases(spark, sf_dir), ["tf"], MODELS, "a", "s")
    return s.select("tf", "n", *(F.round(c, 4 if c in ("suu", "suv") else 6).alias(c) for c in s.columns if c not in ("tf", "n")))


@query("learn", f"""WITH {CASES}, o AS (SELECT c.*, half_life, row_number() OVER (PARTITION BY tf ORDER BY bar_time DESC, root DESC, pair DESC) - 1 AS age, (m1 + m2 + m3) / 3 AS b, CASE WHEN m3 > 0 THEN 0.5 WHEN m3 < 0 THEN -0.5 ELSE 0 END AS news FROM cases c JOIN timeframes USING (tf)),
w AS (SELECT *, pow(0.5, age / half_life) AS w, round(abs(0.2 * b - a) / s, 6) AS ze, (a - 0.2 * b) / s AS rest FROM o), q AS (SELECT tf, ze, sum(w) OVER (PARTITION BY tf ORDER BY ze, m1, m2, m3, a, s ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY tf) AS tot FROM w), k AS (SELECT tf, min(ze) AS ze FROM q WHERE run >= 0.8 * tot - 1e-12 GROUP BY tf),
g AS (SELECT tf, count(*) AS n, sum(w) AS w, (40 + sum(w)) / (40 + sum(w * pow((m1 - a) / s, 2))) AS i1, (40 + sum(w)) / (40 + sum(w * pow((m2 - a) / s, 2))) AS i2, (40 + sum(w)) / (40 + sum(w * pow((m3 - a) / s, 2))) AS i3, sum(w * b * b / (s * s)) AS uu, sum(w * b * a / (s * s)) AS uv, sum(w * rest * news) AS rx, sum(w * news * news) AS xx FROM w GROUP BY tf)
SELECT tf, n, round(i1 / (i1 + i2 + i3), 6) AS w_m1, round(i2 / (i1 + i2 + i3), 6) AS w_m2, round(i3 / (i1 + i2 + i3), 6) AS w_m3, round(greatest(0.6, least(2.5, (30 + w * ze / 1.2816) / (30 + w))), 6) AS k, round(greatest(-0.5, least(1.0, 0.35 * uv / (50 + 0.35 * uu))), 6) AS gain, round(greatest(-0.5, least(0.5, rx / (20 + xx))), 6) AS beta FROM g JOIN k USING (tf)""")
def learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scale, gain and news coefficient per timeframe from all matured cases, recent ones more."""
    df = cases(spark, sf_dir).withColumns({"news": F.signum("m3") * 0.5, "c0": (F.col("m1") + F.col("m2") + F.col("m3")) / 3})
    newest = [F.col("bar_time").desc(), F.col("root").desc(), F.col("pair").desc()]
    df = J.numbered(df, ["tf"], -F.unix_date(F.to_date("bar_time")), newest, "place")
    lives = small(table(spark, sf_dir, "timeframes").select("tf", "half_life"))
    df = df.join(lives, "tf").withColumns({"w": F.pow(F.lit(0.5), (F.col("place") - 1) / F.col("half_life")), "c": 0.2 * F.col("c0"), "g": F.lit(0.2), "k": F.lit(1.0), "x": F.col("news"), "d": F.lit(0.0)})
    return C.learned(df, ["tf"], MODELS, "w")


# --- a ledger of hourly forecasts, made from the bars -----------------------------------------------------------------

PREDICTED = f"""{BARS}, h0 AS (SELECT root, pair, bar_time + INTERVAL 1 HOUR AS ends, close, row_number() OVER (PARTITION BY root, pair ORDER BY bar_time) AS k FROM bars WHERE tf = '1h'),
pr AS (SELECT row_number() OVER (ORDER BY ends, root, pair) AS seq, root, pair, CAST(epoch_us(ends) // 1000000 AS BIGINT) AS origin, close AS p0 FROM h0 WHERE k % 12 = 0)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twelfth hourly bar as an origin: seq, root, pair, origin (seconds) and p0, numbered in order of time."""
    hours = bars_of(spark, sf_dir).where("tf = '1h'")
    k = F.row_number().over(Window.partitionBy("root", "pair").orderBy("bar_time"))
    origins = hours.withColumns({"k": k, "ends": F.timestamp_add("HOUR", F.lit(1), F.col("bar_time"))}).where("k % 12 = 0")
    numbered = J.numbered(origins, [], F.to_date("ends"), ["ends", "root", "pair"], "seq")
    return numbered.select("seq", "root", "pair", seconds("ends").alias("origin"), F.col("close").alias("p0"))


def seconds(column: str) -> F.Column:
    return F.floor(micros(F.col(column)) / 1_000_000).cast("long")


def hour_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark, sf_dir).where("tf = '1h'").select("root", "pair", (seconds("bar_time") + 3600).alias("ends"), "close")


HS = (1, 4)
TERMS = "t AS (SELECT *, unnest([1, 4]) AS h FROM pr), tt AS (SELECT *, origin + h * 3600 AS target FROM t), px AS (SELECT root, pair, CAST(epoch_us(bar_time) // 1000000 AS BIGINT) + 3600 AS ends, close FROM bars WHERE tf = '1h')"


@query("ledger_samples", f"""WITH {PREDICTED}, {TERMS}, o AS (SELECT seq AS pred_seq, h, CASE WHEN seq % 17 <> 0 THEN px.close END AS actual, target // 3600 AS batch FROM tt JOIN px ON px.root = tt.root AND px.pair = tt.pair AND px.ends = tt.target),
m AS (SELECT tt.*, actual FROM tt JOIN o ON o.pred_seq = tt.seq AND o.h = tt.h WHERE batch <= 477312 AND actual IS NOT NULL) SELECT seq, h, round(ln(actual / p0) * 10000, 6) AS a, row_number() OVER (PARTITION BY h ORDER BY target, seq) AS place FROM m""")
def ledger_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a learner may use at a batch: predictions with the outcomes that were recorded by then, void ones left out."""
    said = predicted(spark, sf_dir).withColumn("h", F.explode(F.array(*map(F.lit, HS)))).withColumn("target", F.col("origin") + F.col("h") * 3600)
    hit = said.join(hour_ends(spark, sf_dir).withColumnRenamed("ends", "target"), ["root", "pair", "target"])
    noted = hit.select(F.col("seq").alias("pred_seq"), "h", F.when(F.col("seq") % 17 != 0, F.col("close")).alias("actual"), F.floor(F.col("target") / 3600).cast("long").alias("batch"))
    got = C.samples(said.withColumn("target", F.timestamp_seconds("target")), noted, 477_312)
    return got.select("seq", "h", F.round("a", 6).alias("a"), "place")


NOW = 1_735_689_600  # the instant that the audit is made at


@query("ledger_audit", f"""WITH {PREDICTED}, {TERMS}, p AS (SELECT seq, root, pair, CASE WHEN seq % 97 = 0 THEN origin - 7 ELSE origin END AS origin, origin + CASE WHEN seq % 101 = 0 THEN -60 WHEN seq % 103 = 0 THEN 9000 ELSE 120 END AS issued, p0 * CASE WHEN seq % 107 = 0 THEN 1.001 ELSE 1 END AS p0, h,
  0.3 AS w1, 0.3 AS w2, CASE WHEN seq % 109 = 0 THEN 0.5 ELSE 0.4 END AS w3, CAST(seq % 7 AS DOUBLE) AS c0, 0.2 AS g, 0.1 AS d, 0.2 * (seq % 7) + 0.1 + CASE WHEN seq % 113 = 0 THEN 0.01 ELSE 0 END AS c, target + CASE WHEN seq % 127 = 0 THEN 60 ELSE 0 END AS target FROM tt),
o0 AS (SELECT seq AS pred_seq, h, px.close * CASE WHEN seq % 131 = 0 THEN 1.01 ELSE 1 END AS v, target + CASE WHEN seq % 137 = 0 THEN -60 ELSE 60 END AS noted FROM tt JOIN px ON px.root = tt.root AND px.pair = tt.pair AND px.ends = tt.target WHERE seq % 139 <> 0),
o1 AS (SELECT pred_seq, h, CASE WHEN pred_seq % 149 <> 0 THEN v END AS actual, noted FROM o0), o2 AS (SELECT * FROM o1 UNION ALL SELECT * FROM o1 WHERE pred_seq % 151 = 0 UNION ALL SELECT pred_seq + 10000000, h, actual, noted FROM o1 WHERE pred_seq % 157 = 0),
og AS (SELECT pred_seq AS seq, h, count(*) AS times, min(noted) AS noted, max(actual) AS actual FROM o2 GROUP BY ALL), pb AS (SELECT p.*, px.close AS at_origin FROM p LEFT JOIN px ON px.root = p.root AND px.pair = p.pair AND px.ends = p.origin), met AS (SELECT p.*, times, noted, actual, px.close AS pc FROM p LEFT JOIN og USING (seq, h) LEFT JOIN px ON px.root = p.root AND px.pair = p.pair AND px.ends = p.target),
f AS (SELECT 'issued before its origin' AS kind, seq FROM p WHERE issued < origin UNION ALL SELECT 'origin too old', seq FROM p WHERE issued > origin + 7200 UNION ALL SELECT 'target off the calendar', seq FROM p WHERE target <> origin + h * 3600 UNION ALL SELECT 'origin price', seq FROM pb WHERE at_origin IS NULL OR abs(p0 - at_origin) > 1e-9 * greatest(1, p0, at_origin)
UNION ALL SELECT 'weights', seq FROM p WHERE abs(w1 + w2 + w3 - 1) > 1e-6 UNION ALL SELECT 'centre', seq FROM p WHERE abs(g * c0 + d - c) > 1e-6 UNION ALL SELECT 'issued twice', max(seq) FROM p GROUP BY root, pair, origin, h HAVING count(*) > 1 UNION ALL SELECT 'outcome twice', seq FROM met WHERE times > 1 UNION ALL SELECT 'outcome early', seq FROM met WHERE noted < target
UNION ALL SELECT 'outcome void', seq FROM met WHERE times IS NOT NULL AND actual IS NULL AND pc IS NOT NULL UNION ALL SELECT 'outcome price', seq FROM met WHERE actual IS NOT NULL AND (pc IS NULL OR abs(actual - pc) > 1e-9 * greatest(1, actual, pc)) UNION ALL SELECT 'due and not scored', seq FROM met WHERE times IS NULL AND pc IS NOT NULL AND target <= {NOW} UNION ALL SELECT 'unknown prediction', pred_seq FROM o2 WHERE pred_seq > 10000000)
SELECT kind, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM f GROUP BY kind""")
def ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of a ledger in which some of every kind of record were altered: how many, and the sum of their seqs."""
    when = lambda k, a, b: F.when(F.col("seq") % k == 0, F.lit(a)).otherwise(F.lit(b))
    said = predicted(spark, sf_dir).withColumn("h", F.explode(F.array(*map(F.lit, HS)))).withColumn("target", F.col("origin") + F.col("h") * 3600)
    rest = (F.col("seq") % 7).cast("double")
    p = said.select(
        "seq", "root", "pair", (F.col("origin") - when(97, 7, 0)).alias("origin"), (F.col("origin") + F.when(F.col("seq") % 101 == 0, -60).otherwise(when(103, 9000, 120))).alias("issued"), (F.col("p0") * when(107, 1.001, 1.0)).alias("p0"), "h",
        F.lit(0.3).alias("w1"), F.lit(0.3).alias("w2"), when(109, 0.5, 0.4).alias("w3"), rest.alias("c0"), F.lit(0.2).alias("g"), F.lit(0.1).alias("d"), (0.2 * rest + 0.1 + when(113, 0.01, 0.0)).alias("c"), (F.col("target") + when(127, 60, 0)).alias("target"),
    )
    ends = hour_ends(spark, sf_dir)
    hit = said.join(ends.withColumnRenamed("ends", "target"), ["root", "pair", "target"]).where("seq % 139 <> 0")
    o = hit.select(F.col("seq").alias("pred_seq"), "h", F.when(F.col("seq") % 149 != 0, F.col("close") * when(131, 1.01, 1.0)).alias("actual"), (F.col("target") + when(137, -60, 60)).alias("noted"))
    o = o.unionByName(o.where("pred_seq % 151 = 0")).unionByName(o.where("pred_seq % 157 = 0").withColumn("pred_seq", F.col("pred_seq") + 10_000_000))
    return C.audit(p, o, ends, 3600, F.lit(NOW)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@query("issue_gate", f"""WITH {BARS}, s AS (SELECT root, pair, tf, count(*) AS bars, max(bar_time + minutes * INTERVAL 1 MINUTE) AS origin, any_value(minutes) AS minutes FROM bars JOIN timeframes USING (tf) WHERE minutes > 0 GROUP BY ALL), n AS (SELECT root, max(origin) + INTERVAL 10 MINUTE AS now FROM s GROUP BY root),
i AS (SELECT root, pair, tf, max(bar_time + minutes * INTERVAL 1 MINUTE) AS origin FROM bars JOIN timeframes USING (tf) WHERE minutes > 0 AND root < 'h' AND tf = '1h' GROUP BY ALL)
SELECT root, pair, tf, strftime(origin, '%Y-%m-%d %H:%M:%S') AS origin FROM s JOIN n USING (root) WHERE bars >= 400 AND origin <= now AND now - origin <= CASE tf WHEN '15m' THEN INTERVAL 30 MINUTE ELSE INTERVAL 120 MINUTE END AND origin + minutes * INTERVAL 1 MINUTE > now AND NOT EXISTS (SELECT 1 FROM i WHERE i.root = s.root AND i.pair = s.pair AND i.tf = s.tf AND i.origin = s.origin)""")
def issue_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that a forecast may be issued for ten minutes after the last bar of their root; hourly ones of some roots are issued."""
    minutes = small(table(spark, sf_dir, "timeframes").where("minutes > 0").select("tf", "minutes"))
    bars = bars_of(spark, sf_dir).join(minutes, "tf").withColumn("ends", F.timestamp_add("MINUTE", F.col("minutes"), F.col("bar_time")))
    s = bars.groupBy(*SERIES, "minutes").agg(F.count(F.lit(1)).alias("bars"), F.max("ends").alias("origin"))
    s = s.withColumns({"now": F.timestamp_add("MINUTE", F.lit(10), F.max("origin").over(Window.partitionBy("root"))), "target": F.timestamp_add("MINUTE", F.col("minutes"), F.col("origin"))})
    issued = s.where("root < 'h' AND tf = '1h'").select(*SERIES, "origin")
    return C.issuable(s, issued, SERIES, 400, F.when(F.col("tf") == "15m", 1800).otherwise(7200)).withColumn("origin", stamp("origin"))


# --- events -----------------------------------------------------------------------------------------------------------

LINE = r"^([0-9]{2}):([0-9]{2}) ([A-Z]{3}) ([^()]+) \((High|Medium)\) forecast (-?[0-9.]+) previous (-?[0-9.]+)"
CALENDAR = f"""ln AS (SELECT doc_id, published_at, fetched_at, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND published_at IS NOT NULL), ev AS (SELECT doc_id, date_trunc('day', published_at) + CAST(regexp_extract(line, '{LINE}', 1) AS INTEGER) * INTERVAL 1 HOUR + CAST(regexp_extract(line, '{LINE}', 2) AS INTEGER) * INTERVAL 1 MINUTE AS time,
 regexp_extract(line, '{LINE}', 3) AS cur, regexp_extract(line, '{LINE}', 4) AS title, regexp_extract(line, '{LINE}', 5) AS impact, regexp_extract(line, '{LINE}', 6) AS forecast, regexp_extract(line, '{LINE}', 7) AS previous, fetched_at FROM ln WHERE regexp_matches(line, '{LINE}') AND CAST(regexp_extract(line, '{LINE}', 1) AS INTEGER) < 24)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the documents' calendar lines: doc_id, time, cur, title, impact, forecast, previous, fetched_at."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("published_at").isNotNull())
    lines = d.select("doc_id", F.date_trunc("day", "published_at").cast("timestamp_ntz").alias("day"), "fetched_at", F.explode(F.split("text", "\n")).alias("line"))
    return X.calendar_lines(lines, "day", "line", LINE)


@query("parse_calendar", f"WITH {CALENDAR} SELECT doc_id, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, cur, impact, title, forecast, previous, substr(sha256(strftime(time, '%Y-%m-%d %H:%M:%S') || cur || title), 1, 16) AS id FROM ev")
def parse_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar events with a stable id."""
    ev = calendar(spark, sf_dir).withColumn("time", stamp("time"))
    return ev.select("doc_id", "time", "cur", "impact", "title", "forecast", "previous", F.substring(F.sha2(F.concat("time", "cur", "title"), 256), 1, 16).alias("id"))


@query("events_between", f"""WITH {BARS}, {CALENDAR}, o AS (SELECT root, pair, tf, bar_time, bar_time + INTERVAL 1 DAY AS origin, unnest([substr(pair, 1, 3), substr(pair, 4, 3)]) AS cur FROM bars WHERE tf = '1d'),
m AS (SELECT o.root, o.pair, o.tf, o.bar_time, impact FROM o JOIN ev ON ev.cur = o.cur AND ev.time > o.origin AND ev.time <= o.origin + INTERVAL 3 DAY AND ev.fetched_at < o.origin + INTERVAL 1 DAY)
SELECT {KEY}, count(*) FILTER (impact = 'High') AS high, count(*) FILTER (impact = 'Medium') AS medium, round(CAST(1 + 0.25 * count(*) FILTER (impact = 'High') + 0.08 * count(*) FILTER (impact = 'Medium') AS DOUBLE), 6) AS factor FROM m GROUP BY root, pair, tf, bar_time""")
def events_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a daily bar's currencies in the three days after it, as known a day after it, and what they add to the variance."""
    daily = bars_of(spark, sf_dir).where("tf = '1d'").withColumn("origin", micros(F.col("bar_time")) + DAY_US)
    spans = daily.select(*SERIES, "bar_time", F.explode(F.array(F.substring("pair", 1, 3), F.substring("pair", 4, 3))).alias("cur"), (F.col("origin") + 1).alias("a"), (F.col("origin") + 3 * DAY_US + 1).alias("z"))
    points = calendar(spark, sf_dir).select("cur", micros(F.col("time")).alias("time"), "impact", micros(F.col("fetched_at")).alias("known"))
    met = J.within(points, spans, ["cur"], "time", "a", "z", DAY_US).where(F.col("known") < F.col("a") - 1 + DAY_US)
    n = met.groupBy(*SERIES, "bar_time").agg(F.count_if(F.col("impact") == "High").alias("high"), F.count_if(F.col("impact") == "Medium").alias("medium"))
    return shown(n.withColumn("factor", 1 + 0.25 * F.col("high") + 0.08 * F.col("medium")), ["high", "medium", "factor"])


@query("usable_rates", f"""WITH q AS (SELECT quote_id, root, substr({PAIR}, 1, 3) AS cur, quote_time AS since FROM quotes WHERE quote_time IS NOT NULL), r AS (SELECT root, cur, fetched_at, max(value) AS value FROM rates WHERE value IS NOT NULL AND fetched_at IS NOT NULL GROUP BY ALL)
SELECT quote_id, CASE WHEN q.since - r.fetched_at <= INTERVAL 7 DAY THEN value END AS rate FROM q ASOF LEFT JOIN r ON q.root = r.root AND q.cur = r.cur AND q.since > r.fetched_at""")
def usable_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rate of a quote's base currency stored before it, unless it is more than a week old."""
    q = table(spark, sf_dir, "quotes").where(F.col("quote_time").isNotNull()).select("quote_id", "root", F.substring(plain_pair(F.col("pair")), 1, 3).alias("cur"), micros(F.col("quote_time")).alias("since"))
    r = table(spark, sf_dir, "rates").where(F.col("value").isNotNull()).select("root", "cur", micros(F.col("fetched_at")).alias("stored"), F.col("value").alias("rate"))
    return J.asof(q, r, ["root", "cur"], "since", "stored", ["rate"], tolerance=7 * DAY_US, strict=True, width=32 * DAY_US).select("quote_id", "rate")


# --- season -----------------------------------------------------------------------------------------------------------

WINDOW = 400  # moves that a day's statistics look back on


@query("slot_window", f"""{SLOT}, v AS (SELECT root, pair, slot, x, CAST(bar_time AS DATE) AS day, row_number() OVER (PARTITION BY root, pair ORDER BY bar_time) AS k FROM u WHERE tf = '1h'), d AS (SELECT root, pair, day, min(k) AS cut FROM v GROUP BY ALL),
a AS (SELECT d.root, d.pair, d.day, v.slot, count(*) AS n, sum(x) AS s1, sum(x * x) AS s2 FROM d JOIN v ON v.root = d.root AND v.pair = d.pair AND v.k < d.cut AND v.k >= d.cut - {WINDOW} GROUP BY ALL)
SELECT root, pair, strftime(day, '%Y-%m-%d') AS day, slot, n, round(s1 / n, 6) AS mean FROM a""")
def slot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean move of each slot over the last moves before each day."""
    minutes = table(spark, sf_dir, "timeframes").where("tf = '1h'")
    used = N.slotted(returns(spark, sf_dir).where("tf = '1h'"), minutes)
    return N.window_stats(used, ["root", "pair"], "slot", WINDOW).select("root", "pair", F.date_format("day", "yyyy-MM-dd").alias("day"), "slot", "n", F.round("mean", 6).alias("mean"))


SLOTS = f"{SLOT}, a AS (SELECT root, pair, tf, slot, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM u GROUP BY ALL), st AS (SELECT root, pair, tf, slot, n, CASE WHEN n >= 5 THEN mean ELSE 0 END AS mean, CASE WHEN n >= 5 AND sd > 0 THEN mean / sd * sqrt(n) ELSE 0 END AS t FROM a)"


@query("slot_ranks", f"{SLOTS} SELECT root, pair, tf, slot, row_number() OVER (PARTITION BY root, pair, tf ORDER BY round(abs(t), 9) DESC, slot) AS place FROM st")
def slot_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by how clear their mean is."""
    used = N.slotted(returns(spark, sf_dir), table(spark, sf_dir, "timeframes"))
    s = N.slot_stats(used, "slot", 5)
    return s.select(*SERIES, "slot", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.round(F.abs("t"), 9).desc(), "slot")).cast("long").alias("place"))


@query("step_drift", f"""{SLOTS}, se AS (SELECT *, abs(mean / t) AS se FROM st WHERE t <> 0), tau AS (SELECT root, pair, tf, greatest(0, avg(mean * mean) - avg(se * se)) AS tau2, count(*) AS k FROM se GROUP BY ALL), f AS (SELECT se.*, CASE WHEN k >= 2 THEN tau2 / (tau2 + se * se) ELSE 0 END AS factor FROM se JOIN tau USING (root, pair, tf)),
g AS (SELECT u.root, u.pair, u.tf, u.bar_time, f.mean * f.factor AS d, f.t FROM u JOIN f USING (root, pair, tf, slot) WHERE abs(f.t) >= CASE u.tf WHEN '15m' THEN 4 ELSE 2 END),
n AS (SELECT u.root, u.pair, u.tf, u.bar_time, coalesce(d, 0) AS d, coalesce(t, 0) AS t FROM u LEFT JOIN g USING (root, pair, tf, bar_time)), w AS (SELECT *, CASE WHEN t <> 0 AND d <> 0 THEN abs(d / t) END AS e FROM n)
SELECT {KEY}, round(d, 6) AS d, round(t, 6) AS t, round(sum(d) OVER l, 6) AS centre, round(coalesce(sum(CASE WHEN e IS NOT NULL THEN d END) OVER l / nullif(sqrt(sum(e * e) OVER l), 0), 0), 5) AS centre_t FROM w WINDOW l AS (PARTITION BY root, pair, tf ORDER BY bar_time ROWS 3 PRECEDING)""")
def step_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected move of each bar from its slot, shrunk and called from the timeframe's least t; and of the last four bars together."""
    used = N.slotted(returns(spark, sf_dir), table(spark, sf_dir, "timeframes"))
    called = N.calls(used, 5, {"15m": 4.0}, 2.0)
    return shown(N.combined(called, 4), ["d", "t", "centre", "centre_t"], {"centre_t": 5})


# --- rules and costs ----------------------------------------------------------------------------------------------------

DIFF = f"""e AS (SELECT root, pair, tf, bar_time, close, bar_time + INTERVAL 1 DAY AS since FROM bars WHERE tf = '1d'), kr AS (SELECT root, cur, fetched_at, max(value) AS value FROM rates WHERE value IS NOT NULL AND fetched_at IS NOT NULL GROUP BY ALL),
df AS (SELECT e.*, b.value - q.value AS diff FROM e ASOF LEFT JOIN kr b ON e.root = b.root AND substr(e.pair, 1, 3) = b.cur AND e.since > b.fetched_at ASOF LEFT JOIN kr q ON e.root = q.root AND substr(e.pair, 4, 3) = q.cur AND e.since > q.fetched_at)"""


def with_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with base minus quote rate, each the latest stored by the bar's end."""
    daily = bars_of(spark, sf_dir).where("tf = '1d'").withColumns({"since": micros(F.col("bar_time")) + DAY_US, "base": F.substring("pair", 1, 3), "quote": F.substring("pair", 4, 3)})
    r = table(spark, sf_dir, "rates").where(F.col("value").isNotNull()).select("root", "cur", micros(F.col("fetched_at")).alias("stored"), "value")
    for side in ("base", "quote"):
        daily = J.asof(daily, r.withColumnsRenamed({"cur": side, "value": f"{side}_rate"}), ["root", side], "since", "stored", [f"{side}_rate"], strict=True, width=365 * DAY_US).drop("as_of")
    return daily.withColumn("diff", F.col("base_rate") - F.col("quote_rate"))


@query("rule_signals", f"""WITH {BARS}, {DIFF}, i AS (SELECT *, CASE WHEN diff >= 0.5 THEN 1 WHEN diff <= -0.5 THEN -1 ELSE 0 END AS carry, coalesce(CAST(sign(close / lag(close, 60) OVER ({W}) - 1) AS INTEGER), 0) AS mom, CASE WHEN count(close) OVER l >= 75 THEN round(avg(close) OVER s - avg(close) OVER l, 9) END AS gap FROM df WINDOW s AS ({W} ROWS 19 PRECEDING), l AS ({W} ROWS 74 PRECEDING))
SELECT {KEY}, round(diff, 4) AS diff, carry, mom, CASE WHEN carry = mom THEN carry ELSE 0 END AS carry_mom, coalesce(CAST(sign(gap) AS INTEGER), 0) AS ma_trend FROM i""")
def rule_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of the carry, momentum, carry-and-momentum and trend rules at each daily close."""
    df = with_difference(spark, sf_dir).withColumns({"gap": F.round(V.sma("close", 20) - V.sma("close", 75), 9), "past": F.lag("close", 60).over(B.series_window())})
    sign = lambda c: F.coalesce(F.signum(c).cast("int"), F.lit(0))
    df = df.withColumns({"carry": F.when(F.col("diff") >= 0.5, 1).when(F.col("diff") <= -0.5, -1).otherwise(0), "mom": sign(F.col("close") / F.col("past") - 1), "ma_trend": sign(F.col("gap"))})
    df = df.withColumns({"carry_mom": F.when(F.col("carry") == F.col("mom"), F.col("carry")).otherwise(0), "diff": F.round("diff", 4)})
    return shown(df, ["diff", "carry", "mom", "carry_mom", "ma_trend"], 4)


@query("carry_cost", f"""WITH {BARS}, {DIFF} SELECT df.root AS root, df.pair AS pair, df.tf AS tf, strftime(df.bar_time, '%Y-%m-%d %H:%M:%S') AS bar_time, round((diff - 0.5) * close / pip / 100 / 365 * 5, 6) AS swap_long, round((-diff - 0.5) * close / pip / 100 / 365 * 5, 6) AS swap_short FROM df JOIN fx_pairs ON code = df.pair WHERE diff IS NOT NULL""")
def carry_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pips that holding five days earns or costs on either side, after a markup of half a point a year."""
    pips = small(table(spark, sf_dir, "fx_pairs").select(F.col("code").alias("pair"), "pip"))
    df = with_difference(spark, sf_dir).where(F.col("diff").isNotNull()).join(pips, "pair")
    swap = lambda d: (d * F.col("diff") - 0.5) * F.col("close") / F.col("pip") / 100 / 365 * 5
    return shown(df.withColumns({"swap_long": swap(1), "swap_short": swap(-1)}), ["swap_long", "swap_short"])


@query("spread_cost", f"""WITH p AS (SELECT {PAIR} AS pair, tf, spread FROM prices WHERE spread IS NOT NULL AND spread > 0), m AS (SELECT pair, tf, median(spread) AS mid FROM p GROUP BY ALL) SELECT p.pair AS pair, p.tf AS tf, count(*) AS n, round(any_value(mid) / any_value(pip), 6) AS median_pips, round(avg(least(spread, 20 * mid)) / 2 / any_value(pip), 6) AS cost_pips FROM p JOIN m USING (pair, tf) JOIN fx_pairs ON code = p.pair GROUP BY p.pair, p.tf""")
def spread_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the recorded spread in pips, spreads cut at twenty medians."""
    pips = small(table(spark, sf_dir, "fx_pairs").select(F.col("code").alias("pair"), "pip"))
    p = table(spark, sf_dir, "prices").where(F.col("spread") > 0).select(plain_pair(F.col("pair")).alias("pair"), "tf", "spread").join(pips, "pair").withColumn("spread", F.col("spread") / F.col("pip"))
    mid = P.quantiles(p, ["pair", "tf"], "spread", {"mid": 0.5}, 0.1)
    g = p.join(mid, ["pair", "tf"]).groupBy("pair", "tf", "mid").agg(F.count(F.lit(1)).alias("n"), F.avg(F.least("spread", 20 * F.col("mid"))).alias("cost"))
    return g.select("pair", "tf", "n", F.round("mid", 6).alias("median_pips"), F.round(F.col("cost") / 2, 6).alias("cost_pips"))


# --- tests and readings ---------------------------------------------------------------------------------------------------


@query("dm_by_date", f"""WITH {RETURNS}, d AS (SELECT tf, CAST(bar_time AS DATE) AS day, avg(pow(0.1 * x - y, 2) - pow(y, 2)) AS d FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), c AS (SELECT *, d - avg(d) OVER (PARTITION BY tf) AS e FROM d),
l AS (SELECT *, e * lag(e, 1) OVER o AS e1, e * lag(e, 2) OVER o AS e2 FROM c WINDOW o AS (PARTITION BY tf ORDER BY day)), a AS (SELECT tf, count(*) AS n, avg(d) AS m, sum(e * e) / count(*) + 2 * (1 - 1.0 / 3) * sum(e1) / count(*) + 2 * (1 - 2.0 / 3) * sum(e2) / count(*) AS v FROM l GROUP BY tf) SELECT tf, n, round(CASE WHEN n >= 8 AND v > 0 THEN m / sqrt(v / n) END, 5) AS dm FROM a""")
def dm_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison of two forecasts on the mean loss of each date, for pairs move together."""
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({"day": F.to_date("bar_time"), "d": F.pow(0.1 * F.col("x") - F.col("y"), 2) - F.pow("y", F.lit(2))})
    return P.diebold_mariano(C.by_date(df, ["tf"], "day", "d"), ["tf"], "day", "d", 2).withColumn("dm", F.round(F.col("dm"), 5))


NUS = (4, 5, 6, 10)


def log_sql(nu: int) -> str:
    unit = M.t_unit(nu)
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(unit)
    return f"avg({const!r} - {(nu + 1) / 2} * ln(1 + a * a / (s * s) / {unit * unit * nu!r}) - ln(s))"


@query("t_log_score", f"WITH {CASES}, g AS (" + " UNION ALL ".join(f"SELECT tf, {nu} AS nu, {log_sql(nu)} AS score FROM cases GROUP BY tf" for nu in NUS) + ") SELECT tf, nu, round(score, 6) AS score, nu = arg_max(nu, round(score, 9)) OVER (PARTITION BY tf) AS chosen FROM g")
def t_log_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log density of moves under t shapes, and the best number of degrees of freedom."""
    df = cases(spark, sf_dir)
    z = F.col("a") / F.col("s")
    scores = df.groupBy("tf").agg(*(F.avg(C.log_density(z, nu) - F.log("s")).alias(f"_{nu}") for nu in NUS))
    rows = scores.select("tf", F.inline(F.array(*(F.struct(F.lit(nu).alias("nu"), F.col(f"_{nu}").alias("score")) for nu in NUS))))
    best = F.max_by("nu", F.round("score", 9)).over(Window.partitionBy("tf"))
    return rows.select("tf", "nu", F.round("score", 6).alias("score"), (F.col("nu") == best).alias("chosen"))


@query("verdicts", f"""WITH {CASES}, v AS (SELECT tf, bar_time < TIMESTAMP '2024-01-01' AS tune, unnest(['last', 'slow', 'against']) AS rule, unnest([sign(m2) * a, sign(m3) * a, -sign(m2) * a]) AS v FROM cases), g AS (SELECT tf, rule, avg(v) FILTER (tune) / stddev_samp(v) FILTER (tune) * sqrt(count(*) FILTER (tune)) AS tune, avg(v) FILTER (NOT tune) / stddev_samp(v) FILTER (NOT tune) * sqrt(count(*) FILTER (NOT tune)) AS test FROM v GROUP BY ALL)
SELECT tf, rule, round(tune, 5) AS tune, round(test, 5) AS test, CASE WHEN abs(tune) >= 2 AND sign(tune) = sign(test) AND abs(test) >= 2 THEN 'adopt' WHEN abs(tune) >= 2 THEN 'fails' ELSE 'reject' END AS verdict FROM g""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules chosen on the earlier period and judged on the later one."""
    a = F.col("a")
    each = F.array(*(F.struct(F.lit(n).alias("rule"), v.alias("v")) for n, v in (("last", F.signum("m2") * a), ("slow", F.signum("m3") * a), ("against", -F.signum("m2") * a))))
    df = cases(spark, sf_dir).select("tf", (F.col("bar_time") < F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).alias("early"), F.inline(each))
    t = lambda on: F.avg(F.when(on, F.col("v"))) / F.nullif(F.stddev_samp(F.when(on, F.col("v"))), F.lit(0.0)) * F.sqrt(F.count_if(on))
    g = df.groupBy("tf", "rule").agg(t(F.col("early")).alias("tune"), t(~F.col("early")).alias("test"))
    return g.select("tf", "rule", F.round("tune", 5).alias("tune"), F.round("test", 5).alias("test"), C.verdict(F.col("tune"), F.col("test")).alias("verdict"))


@query("strength_ls")
def strength_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move of each currency on each day by least squares over the pairs, over all roots."""
    df = returns(spark, sf_dir).where("tf = '1d' AND x IS NOT NULL").select(F.to_date("bar_time").alias("day"), F.substring("pair", 1, 3).alias("base"), F.substring("pair", 4, 3).alias("quote"), "x")
    return C.strengths(df, ["day"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "cur", F.round("strength", 4).alias("strength"))


READ_SQL = """SELECT root, pair, tf, CASE WHEN rsi >= 70 THEN -1 WHEN rsi <= 30 THEN 1 ELSE 0 END AS rsi_bias, CASE WHEN was20 <= was75 AND a20 > a75 THEN 'golden cross' WHEN was20 >= was75 AND a20 < a75 THEN 'dead cross' WHEN a20 > a75 THEN 'above' ELSE 'below' END AS averages,
CASE WHEN a200 IS NULL THEN 0 WHEN close > a200 THEN 1 ELSE -1 END AS long_bias, CASE WHEN m > sig THEN 1 ELSE -1 END AS macd_bias, CASE WHEN pctb >= 1 THEN -1 WHEN pctb <= 0 THEN 1 ELSE 0 END AS band_bias FROM {frame}"""


@query("technical_summary", f"""{FRAME_SQL}, z9 AS (SELECT root, pair, tf, bar_time, close, rsi, round(sma20, 9) AS a20, round(sma75, 9) AS a75, round(sma200, 9) AS a200, round(macd, 9) AS m, round(macd_signal, 9) AS sig, coalesce(pctb, 0.5) AS pctb FROM frame), y9 AS (SELECT *, lag(a20) OVER ({W}) AS was20, lag(a75) OVER ({W}) AS was75, row_number() OVER (PARTITION BY root, pair, tf ORDER BY bar_time DESC) AS back FROM z9),
last9 AS (SELECT * FROM y9 WHERE back = 1 AND was75 IS NOT NULL) {READ_SQL.format(frame='last9')}""")
def technical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last two bars of each series say: overbought or oversold, averages, long trend, convergence, bands."""
    from quillon.operators import signals as S

    w = B.series_window()
    f = S.indicator_frame(bars_of(spark, sf_dir))
    f = f.select(*SERIES, "bar_time", "close", "rsi", *(F.round(a, 9).alias(b) for a, b in (("sma20", "a20"), ("sma75", "a75"), ("sma200", "a200"), ("macd", "m"), ("macd_signal", "sig"))), F.coalesce("pctb", F.lit(0.5)).alias("pctb"))
    f = C.latest(f.withColumns({"was20": F.lag("a20").over(w), "was75": F.lag("a75").over(w)}), SERIES, "bar_time").where(F.col("was75").isNotNull())
    columns = READ_SQL.split("SELECT root, pair, tf, ")[1].split(" FROM {frame}")[0]
    return f.selectExpr(*SERIES, *[c.strip() for c in split_top(columns)])


def split_top(columns: str) -> list[str]:
    """Expressions of a select list (none of them holds a comma)."""
    return columns.replace("\n", " ").split(", ")


# --- paths, backtests, made markets -----------------------------------------------------------------------------------------

PATH_SQL = f"""{SLOT}, hp AS (SELECT * FROM u WHERE tf = '1h'), pa AS (SELECT root, pair, tod, avg(x * x) AS v FROM hp GROUP BY ALL), pb AS (SELECT a.root, a.pair, a.tod, 0.5 * a.v + 0.25 * coalesce(l.v, a.v) + 0.25 * coalesce(h.v, a.v) AS w FROM pa a LEFT JOIN pa l ON l.root = a.root AND l.pair = a.pair AND l.tod = (a.tod + 23) % 24 LEFT JOIN pa h ON h.root = a.root AND h.pair = a.pair AND h.tod = (a.tod + 1) % 24),
pf AS (SELECT root, pair, tod, w / avg(w) OVER (PARTITION BY root, pair) AS profile FROM pb), uu AS (SELECT hp.root, hp.pair, hp.bar_time, x * x / profile AS u2, row_number() OVER (PARTITION BY hp.root, hp.pair ORDER BY hp.bar_time) AS rn FROM hp JOIN pf USING (root, pair, tod)),
st AS (SELECT *, avg(u2) OVER (PARTITION BY root, pair ORDER BY bar_time ROWS 19 PRECEDING) AS m20, avg(u2) OVER (PARTITION BY root, pair ORDER BY bar_time ROWS 1499 PRECEDING) AS long FROM uu), er AS (SELECT root, pair, rn, m20 AS e FROM st WHERE rn = 20 UNION ALL SELECT s.root, s.pair, s.rn, 0.03 * s.u2 + 0.97 * er.e FROM er JOIN st s ON s.root = er.root AND s.pair = er.pair AND s.rn = er.rn + 1),
la AS (SELECT st.root, st.pair, max(rn) AS rn, max(bar_time) + INTERVAL 1 HOUR AS origin, arg_max(long, bar_time) AS long FROM st GROUP BY ALL), lb AS (SELECT la.*, e FROM la JOIN er USING (root, pair, rn)), sl AS (SELECT root, pair, origin, long, e, unnest(generate_series(origin, origin + INTERVAL 6 DAY, INTERVAL 1 HOUR)) AS slot FROM lb),
so AS (SELECT *, slot AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS ny FROM sl), sk AS (SELECT *, row_number() OVER (PARTITION BY root, pair ORDER BY slot) AS k, coalesce(lag(slot) OVER (PARTITION BY root, pair ORDER BY slot) + INTERVAL 1 HOUR, origin) AS was FROM so WHERE (isodow(ny) <= 4) OR (isodow(ny) = 5 AND hour(ny) < 17) OR (isodow(ny) = 7 AND hour(ny) >= 17))
SELECT sk.root AS root, sk.pair AS pair, k, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(sqrt((long + (e - long) * pow(0.985, k)) * coalesce(profile, 1) + CASE WHEN slot > was THEN 2 * long ELSE 0 END), 4) AS sigma FROM sk LEFT JOIN pf ON pf.root = sk.root AND pf.pair = sk.pair AND pf.tod = hour(ny) WHERE k <= 24"""


@query("variance_path", PATH_SQL.replace("WITH ", "WITH RECURSIVE ", 1))
def variance_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each of the next 24 open hours: a level that goes back to the long mean, by time of day, and closed gaps."""
    used = N.slotted(returns(spark, sf_dir).where("tf = '1h'"), table(spark, sf_dir, "timeframes").where("tf = '1h'"))
    return Y.path_ahead(used, 24, 60).select("root", "pair", "k", stamp("slot"), F.round(F.sqrt("variance"), 4).alias("sigma"))


@query("backtest_rows")
def backtest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of every model from ten origins of each daily series, each from the bars up to it, with what followed."""
    rows = M.backtests(bars_of(spark, sf_dir).where("tf = '1d'"), [1, 5, 10, 20], 10, 20, 130)
    return rows.select(*SERIES, stamp("origin"), "model", "h", F.round("bp", 4).alias("bp"), F.round("actual", 4).alias("actual"))


def uniform_sql(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT + 0.5) / {float(1 << 48)!r})"


Z_SQL = f"sqrt(-2 * ln({uniform_sql(repr('a'), '7', 'pair', 'k')})) * cos(2 * pi() * {uniform_sql(repr('b'), '7', 'pair', 'k')})"


@query("synthetic_market", f"""WITH g AS (SELECT code AS pair, unnest(generate_series(0, 499)) AS k FROM fx_pairs), z AS (SELECT *, 0.001 * {Z_SQL} AS z FROM g), c AS (SELECT *, exp(sum(z) OVER (PARTITION BY pair ORDER BY k)) AS close FROM z), o AS (SELECT *, close / exp(z) AS open FROM c)
SELECT pair, k, round(open, 8) AS open, round(greatest(open, close) * (1 + 0.0005 * {uniform_sql(repr('r1'), '7', 'pair', 'k')}), 8) AS high, round(least(open, close) * (1 - 0.0005 * {uniform_sql(repr('r-1'), '7', 'pair', 'k')}), 8) AS low, round(close, 8) AS close FROM o""")
def synthetic_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred made hours of each pair; a longer market begins with the same bars."""
    pairs = table(spark, sf_dir, "fx_pairs").select(F.col("code").alias("pair"), F.lit(1.0).alias("level"))
    bars = synthetic.hourly_bars(pairs, 500, 7, block=128)
    return bars.select("pair", "k", *(F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")))


TONE = (3, 48, 168)


def tone_sql(h: int) -> str:
    w = f"(PARTITION BY cur ORDER BY hour RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
    return f"round(sum(s) OVER {w} / sum(n) OVER {w}, 6) AS tone{h}"


@query("tone", f"WITH {SAID}, e AS (SELECT cur, round(tanh(v / 1.5), 3) AS score, epoch_us(published_at) // 3600000000 AS hour FROM s WHERE published_at IS NOT NULL), g AS (SELECT cur, hour, sum(score) AS s, count(*) AS n FROM e GROUP BY ALL) SELECT cur, hour, {', '.join(map(tone_sql, TONE))} FROM g")
def tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each currency's headlines over the last 3, 48 and 168 hours, at every hour with one."""
    d = table(spark, sf_dir, "documents")
    hour = F.floor(micros(F.col("published_at")) / 3_600_000_000).cast("long")
    e = X.scores(d).join(d.select("doc_id", hour.alias("hour")), "doc_id").where(F.col("hour").isNotNull())
    g = e.groupBy("cur", "hour").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    w = lambda h: Window.partitionBy("cur").orderBy("hour").rangeBetween(-(h - 1), 0)
    return g.select("cur", "hour", *(F.round(F.sum("s").over(w(h)) / F.sum("n").over(w(h)), 6).alias(f"tone{h}") for h in TONE))


@query("committed_before", f"WITH l AS (SELECT root, line_id, {PAIR} AS pair, row_number() OVER (PARTITION BY root ORDER BY line_id) AS n FROM prices), b AS (SELECT *, CAST(ceil(n / 250.0) AS BIGINT) AS batch FROM l), g AS (SELECT root, batch, count(*) AS k FROM b GROUP BY ALL) SELECT root, batch, CAST(coalesce(sum(k) OVER (PARTITION BY root ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lines FROM g")
def committed_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each root were committed before each batch: what a reader as of that batch sees."""
    lines = J.numbered(table(spark, sf_dir, "prices").select("root", "line_id"), ["root"], floor_div(F.col("line_id"), 65_536), ["line_id"], "n")
    g = lines.groupBy("root", F.ceil(F.col("n") / 250).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("root").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("root", "batch", F.coalesce(F.sum("k").over(w), F.lit(0)).cast("long").alias("lines"))


@query("roll_shift")
def roll_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected move of hourly bars that start at the roll, from the rate difference and the days that the value date moves."""
    hours = bars_of(spark, sf_dir).where("tf = '1h'").withColumns({"since": micros(F.col("bar_time")), "base": F.substring("pair", 1, 3), "quote": F.substring("pair", 4, 3)})
    r = table(spark, sf_dir, "rates").where(F.col("value").isNotNull()).select("root", "cur", micros(F.col("fetched_at")).alias("stored"), "value")
    for side in ("base", "quote"):
        hours = J.asof(hours, r.withColumnsRenamed({"cur": side, "value": f"{side}_rate"}), ["root", side], "since", "stored", [f"{side}_rate"], strict=True, width=365 * DAY_US).drop("as_of")
    span = hours.agg(F.min(F.year("bar_time")).alias("a"), F.max(F.year("bar_time")).alias("z")).first()
    years = range(span.a, span.z + 1) if span.a is not None else range(2024, 2025)
    pairs = [(r.base, r.quote) for r in few(table(spark, sf_dir, "fx_pairs").where(F.col("base").isin(*K.RULES) & F.col("quote").isin(*K.RULES)).select("base", "quote").distinct())]
    days = small(K.spot_table(spark, pairs, years).select("pair", "day", "roll_days"), 100_000)
    return shown(N.roll_shift(hours, days, F.col("base_rate") - F.col("quote_rate")), ["shift", "roll_days"])


@query("forecast_candles")
def forecast_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty candles after each daily series."""
    made = candles.forecast_candles(bars_of(spark, sf_dir).where("tf = '1d'"), 20)
    return made.select(*SERIES, "k", *(F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")))
