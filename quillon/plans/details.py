"""Queries of smaller operators: cut-offs, other forms of indicators, decayed histograms, budgets, positions, canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions.times import floor_div, micros
from quillon.operators import bars as B, joins as J, season as N, text as X, windows as V
from quillon.plans.records import SAID, titles
from quillon.plans.scoring import RETURNS, SLOT, returns
from quillon.plans.shared import BARS, KEY, Registry, W, bars_of, shown
from quillon.sources.tables import SERIES, small, table

query = Registry()
QUERIES, ORACLE = query.queries, query.sql


@query("bars_until", f"WITH {BARS} SELECT {KEY} FROM bars JOIN timeframes USING (tf) WHERE minutes > 0 AND bar_time + minutes * INTERVAL 1 MINUTE <= TIMESTAMP '2024-02-15 12:30:00'")
def bars_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday bars that had ended at an instant."""
    minutes = small(table(spark, sf_dir, "timeframes").where("minutes > 0").select("tf", "minutes"))
    return shown(bars_of(spark, sf_dir).join(minutes, "tf").where(B.bar_end(F.col("minutes")) <= F.expr("TIMESTAMP_NTZ '2024-02-15 12:30:00'")), [])


@query("pivots_weekly", f"""WITH {BARS}, w AS (SELECT root, pair, tf, date_trunc('week', bar_time) AS week, max(high) AS h, min(low) AS l, arg_max(close, bar_time) AS c FROM bars WHERE tf = '1d' GROUP BY ALL), p AS (SELECT root, pair, tf, week, lag(h) OVER o AS h, lag(l) OVER o AS l, lag(c) OVER o AS c FROM w WINDOW o AS (PARTITION BY root, pair, tf ORDER BY week))
SELECT root, pair, tf, strftime(week, '%Y-%m-%d') AS week, round((h + l + c) / 3, 9) AS pivot, round(2 * (h + l + c) / 3 - l, 9) AS r1, round(2 * (h + l + c) / 3 - h, 9) AS s1 FROM p""")
def pivots_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots of each week from the week before."""
    weeks = B.bucketed(bars_of(spark, sf_dir).where("tf = '1d'"), SERIES, "bar_time", F.date_trunc("week", "bar_time"))
    w = Window.partitionBy(*SERIES).orderBy("bucket")
    names = V.pivots(*(F.lag(c).over(w) for c in ("high", "low", "close")))
    return weeks.select(*SERIES, F.date_format("bucket", "yyyy-MM-dd").alias("week"), *(F.round(names[n], 9).alias(n) for n in ("pivot", "r1", "s1")))


TR = "greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0))"


@query("atr_mean", f"WITH {BARS}, p AS (SELECT *, lag(close) OVER ({W}) AS pc FROM bars), t AS (SELECT *, {TR} AS tr FROM p) SELECT {KEY}, round(CASE WHEN count(tr) OVER ({W} ROWS 13 PRECEDING) >= 14 THEN avg(tr) OVER ({W} ROWS 13 PRECEDING) END, 9) AS atr, round(CASE WHEN count(tr) OVER ({W} ROWS 13 PRECEDING) >= 14 THEN avg(tr) OVER ({W} ROWS 13 PRECEDING) / close * 100 END, 6) AS percent FROM t")
def atr_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain mean of the true range, and in percent of the close."""
    df = bars_of(spark, sf_dir).withColumn("tr", V.true_range(True)).withColumn("atr", V.sma("tr", 14))
    return shown(df.withColumn("percent", F.col("atr") / F.col("close") * 100), ["atr", "percent"], {"atr": 9})


@query("overnight_gap", f"WITH {BARS}, h AS (SELECT root, pair, CAST(bar_time AS DATE) AS day, arg_min(open, bar_time) AS o, arg_max(close, bar_time) AS c FROM bars WHERE tf = '1h' GROUP BY ALL), g AS (SELECT *, lag(c) OVER (PARTITION BY root, pair ORDER BY day) AS pc FROM h) SELECT root, pair, strftime(day, '%Y-%m-%d') AS day, round(ln(o / pc) * 10000, 5) AS gap, round(ln(c / o) * 10000, 5) AS inside FROM g WHERE pc IS NOT NULL")
def overnight_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move between the days and move within, in basis points."""
    days = B.bucketed(bars_of(spark, sf_dir).where("tf = '1h'"), ["root", "pair"], "bar_time", F.to_date("bar_time"))
    before = F.lag("close").over(Window.partitionBy("root", "pair").orderBy("bucket"))
    g = days.withColumn("pc", before).where(F.col("pc").isNotNull())
    bp = lambda a, b: F.round(F.log(F.col(a) / F.col(b)) * 10_000, 5)
    return g.select("root", "pair", F.date_format("bucket", "yyyy-MM-dd").alias("day"), bp("open", "pc").alias("gap"), bp("close", "open").alias("inside"))


@query("decayed_histogram", f"""WITH {RETURNS}, a AS (SELECT tf, y, row_number() OVER (PARTITION BY root, pair, tf ORDER BY bar_time DESC) - 1 AS age FROM r WHERE y IS NOT NULL), h AS (SELECT tf, CAST(floor(ln(greatest(abs(y), 0.01)) * 50) AS BIGINT) AS bin, sum(pow(0.5, age / 100.0)) AS w FROM a GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY tf ORDER BY bin) AS run, sum(w) OVER (PARTITION BY tf) AS total FROM h) SELECT tf, min(bin) AS bin FROM c WHERE run >= 0.8 * total GROUP BY tf""")
def decayed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.8 quantile of moves from a histogram in which recent moves count more; the weights add up before the shuffle."""
    age = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())) - 1
    df = returns(spark, sf_dir).where(F.col("y").isNotNull()).withColumn("w", F.pow(F.lit(0.5), age / 100.0))
    h = df.groupBy("tf", F.floor(F.log(F.greatest(F.abs("y"), F.lit(0.01))) * 50).cast("long").alias("bin")).agg(F.sum("w").alias("w"))
    w = Window.partitionBy("tf")
    c = h.withColumns({"run": F.sum("w").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("w").over(w)})
    return c.where(F.col("run") >= 0.8 * F.col("total")).groupBy("tf").agg(F.min("bin").alias("bin"))


@query("probability_scores", f"""WITH {RETURNS}, p AS (SELECT tf, 1 / (1 + exp(-x / 10)) AS p, CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END AS up, abs(y) / nullif(stddev_pop(x) OVER ({W} ROWS 19 PRECEDING), 0) AS z FROM r WHERE x IS NOT NULL AND y IS NOT NULL), b AS (SELECT tf, avg(up) AS base FROM p GROUP BY tf)
SELECT tf, count(*) AS n, round(avg(pow(p - up, 2)), 6) AS brier, round(1 - avg(pow(p - up, 2)) / avg(pow(base - up, 2)), 6) AS skill, round(avg(CASE WHEN z <= 1.2816 THEN 1.0 ELSE 0.0 END) FILTER (z IS NOT NULL), 6) AS cover80, round(-avg(up * ln(greatest(1e-6, p)) + (1 - up) * ln(greatest(1e-6, 1 - p))), 6) AS log_loss FROM p JOIN b USING (tf) GROUP BY tf""")
def probability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and skill against the base rate, log loss, and how many moves the central 80 % hold."""
    df = returns(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    df = df.withColumns({"p": 1 / (1 + F.exp(-F.col("x") / 10)), "up": (F.col("y") > 0).cast("double"), "z": F.abs("y") / F.nullif(F.stddev_pop("x").over(B.trailing(20)), F.lit(0.0))})
    p, up = F.col("p"), F.col("up")
    # the base rate is a mean, so its squared error follows from the same sums
    g = df.groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(p - up, 2)).alias("brier"), F.avg(up).alias("base"), F.avg((F.col("z") <= 1.2816).cast("double")).alias("cover80"), (-F.avg(up * F.log(F.greatest(F.lit(1e-6), p)) + (1 - up) * F.log(F.greatest(F.lit(1e-6), 1 - p)))).alias("log_loss"))
    return g.select("tf", "n", F.round("brier", 6).alias("brier"), F.round(1 - F.col("brier") / (F.col("base") * (1 - F.col("base"))), 6).alias("skill"), F.round("cover80", 6).alias("cover80"), F.round("log_loss", 6).alias("log_loss"))


@query("slot_grounds", f"""{SLOT}, a AS (SELECT root, pair, tf, slot, any_value(tod) AS tod, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM u GROUP BY root, pair, tf, slot), b AS (SELECT root, pair, tf, tod, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd FROM u GROUP BY ALL), g AS (SELECT a.root, a.pair, a.tf, slot, a.n AS n_slot, b.n AS n_tod, CASE WHEN a.n >= 5 AND a.sd > 0 THEN a.mean / a.sd * sqrt(a.n) ELSE 0 END AS t_slot, CASE WHEN b.n >= 5 AND b.sd > 0 THEN b.mean / b.sd * sqrt(b.n) ELSE 0 END AS t_tod FROM a JOIN b USING (root, pair, tf, tod))
SELECT root, pair, tf, slot, n_slot, n_tod, round(t_slot, 5) AS t_slot, round(t_tod, 5) AS t_tod, CASE WHEN abs(t_slot) >= 2 THEN 'slot' WHEN abs(t_tod) >= 2 THEN 'tod' ELSE 'none' END AS used FROM g""")
def slot_grounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a call in each slot rests on: the slot, the time of day, or nothing."""
    used = N.slotted(returns(spark, sf_dir), table(spark, sf_dir, "timeframes"))
    times = used.select(*SERIES, "slot", "tod").distinct()
    a = N.slot_stats(used, "slot", 5).select(*SERIES, "slot", F.col("n").alias("n_slot"), F.col("t").alias("t_slot"))
    b = N.slot_stats(used, "tod", 5).select(*SERIES, "tod", F.col("n").alias("n_tod"), F.col("t").alias("t_tod"))
    g = times.join(a, [*SERIES, "slot"]).join(b, [*SERIES, "tod"])
    grounds = F.when(F.abs("t_slot") >= 2, "slot").when(F.abs("t_tod") >= 2, "tod").otherwise("none")
    return g.select(*SERIES, "slot", "n_slot", "n_tod", F.round("t_slot", 5).alias("t_slot"), F.round("t_tod", 5).alias("t_tod"), grounds.alias("used"))


@query("work_budget", f"WITH {BARS}, s AS (SELECT root, pair, tf, count(*) AS cost FROM bars GROUP BY ALL), c AS (SELECT *, sum(cost) OVER (PARTITION BY root ORDER BY cost, pair, tf) AS upto FROM s) SELECT root, pair, tf, cost FROM c WHERE upto <= 1500")
def work_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of each root that fit a budget of bars, the cheapest first."""
    s = bars_of(spark, sf_dir).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("cost"))
    upto = F.sum("cost").over(Window.partitionBy("root").orderBy("cost", "pair", "tf"))
    return s.withColumn("upto", upto).where("upto <= 1500").select(*SERIES, "cost")


@query("uncommitted_tail", "WITH l AS (SELECT root, line_id, row_number() OVER (PARTITION BY root ORDER BY line_id) AS n, count(*) OVER (PARTITION BY root) AS total FROM prices) SELECT root, line_id FROM l WHERE n > total // 250 * 250")
def uncommitted_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after the last whole batch of 250 of each root: what a store cuts off when it opens."""
    lines = J.numbered(table(spark, sf_dir, "prices").select("root", "line_id"), ["root"], floor_div(F.col("line_id"), 65_536), ["line_id"], "n")
    totals = lines.groupBy("root").agg(F.count(F.lit(1)).alias("total"))
    return lines.join(totals, "root").where(F.col("n") > F.floor(F.col("total") / 250) * 250).select("root", "line_id")


@query("cue_positions", """WITH t AS (SELECT doc_id, trim(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END, ' ') AS title FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, title, regexp_extract(title, '(USD|EUR|GBP|JPY|AUD|NZD|CAD|CHF)', 0) AS cur, regexp_extract(title, '(rose|fell|slipped|firmed|eased|jumped)', 0) AS cue FROM t)
SELECT doc_id, cur, cue, instr(title, cur) AS cur_at, instr(title, cue) AS cue_at, instr(title, cue) - instr(title, cur) AS apart FROM m WHERE cur <> '' AND cue <> ''""")
def cue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a title first names a currency and first says a move, and how far apart."""
    part = lambda p: F.regexp_extract("title", p, 0)
    m = titles(spark, sf_dir).select("doc_id", "title", part("(USD|EUR|GBP|JPY|AUD|NZD|CAD|CHF)").alias("cur"), part("(rose|fell|slipped|firmed|eased|jumped)").alias("cue")).where("cur <> '' AND cue <> ''")
    m = m.withColumns({"cur_at": F.expr("instr(title, cur)").cast("long"), "cue_at": F.expr("instr(title, cue)").cast("long")})
    return m.select("doc_id", "cur", "cue", "cur_at", "cue_at", (F.col("cue_at") - F.col("cur_at")).alias("apart"))


@query("canonical_hashes", "SELECT rate_id, sha256(CAST(json_object('cur', cur, 'day', strftime(obs_date, '%Y-%m-%d'), 'id', rate_id, 'sid', sid) AS VARCHAR)) AS hash FROM rates WHERE cur IS NOT NULL AND obs_date IS NOT NULL AND sid IS NOT NULL")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each rate as a record whose bytes don't depend on the order of its fields: keys sorted, no blanks."""
    r = table(spark, sf_dir, "rates").where(F.col("cur").isNotNull() & F.col("obs_date").isNotNull() & F.col("sid").isNotNull())
    record = F.struct("cur", F.date_format("obs_date", "yyyy-MM-dd").alias("day"), F.col("rate_id").alias("id"), "sid")
    return r.select("rate_id", F.sha2(F.to_json(record), 256).alias("hash"))


@query("relevant_headlines", f"WITH {SAID} SELECT DISTINCT doc_id FROM s WHERE round(tanh(v / 1.5), 3) <> 0")
def relevant_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say something of a currency."""
    return X.scores(table(spark, sf_dir, "documents")).where("score <> 0").select("doc_id").distinct()


@query("rate_history", """WITH r AS (SELECT root, sid, freq, obs_date, value, max(obs_date) OVER (PARTITION BY root, sid) AS top FROM rates WHERE value IS NOT NULL AND fetched_at IS NOT NULL) SELECT root, sid, count(*) AS n, strftime(min(obs_date), '%Y-%m-%d') AS first_day, round(avg(value), 6) AS mean FROM r WHERE obs_date > top - CASE freq WHEN 'd' THEN 460 ELSE 913 END GROUP BY root, sid""")
def rate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trailing history of each rate series: 460 days of daily ones, thirty months of monthly ones."""
    r = table(spark, sf_dir, "rates").where(F.col("value").isNotNull() & F.col("fetched_at").isNotNull())
    top = r.groupBy("root", "sid").agg(F.max("obs_date").alias("top"))
    kept = r.join(top, ["root", "sid"]).where(F.datediff("top", "obs_date") < F.when(F.col("freq") == "d", 460).otherwise(913))
    return kept.groupBy("root", "sid").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("obs_date"), "yyyy-MM-dd").alias("first_day"), F.round(F.avg("value"), 6).alias("mean"))


@query("first_event", """WITH e AS (SELECT user_id, event_id, ts, event_type FROM events), p AS (SELECT event_id AS purchase, user_id, ts AS since FROM e WHERE event_type = 'purchase'), m AS (SELECT purchase, arg_min(e.event_id, (e.ts, e.event_id)) AS event_id FROM p JOIN e ON e.user_id = p.user_id AND e.ts > p.since AND e.ts <= p.since + INTERVAL 1 DAY GROUP BY purchase) SELECT purchase, m.event_id AS event_id FROM m""")
def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a user within a day after each purchase."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("t"), "event_type")
    spans = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", (F.col("t") + 1).alias("a"), (F.col("t") + 86_400_000_001).alias("z"))
    met = J.within(e.select("user_id", "event_id", "t"), spans, ["user_id"], "t", "a", "z", 86_400_000_000)
    return met.groupBy("purchase").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("event_id"))
