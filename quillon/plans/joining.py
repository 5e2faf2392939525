"""Queries of the joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions.times import DAY_US, micros
from quillon.operators import bars as B, joins as J
from quillon.plans.shared import BARS, KEY, PAIR, Registry, W, bars_of, shown, stamp
from quillon.sources.tables import SERIES, lengths, plain_pair, small, table

query = Registry()
QUERIES, ORACLE = query.queries, query.sql

MONTH_US = 32 * DAY_US  # blocks of time that as-of joins are cut into


def quotes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "quotes").where(F.col("quote_time").isNotNull())
    return q.select("quote_id", "root", plain_pair(F.col("pair")).alias("pair"), "tf", "price", micros(F.col("quote_time")).alias("at"))


def ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = small(table(spark, sf_dir, "timeframes").select("tf", "minutes"))
    return bars_of(spark, sf_dir).join(minutes, "tf").where(F.col("minutes") > 0).withColumn("bar_end", micros(F.col("bar_time")) + F.col("minutes").cast("long") * 60_000_000)


ENDED = f"{BARS}, ended AS (SELECT root, pair, tf, close, epoch_us(bar_time) + minutes::BIGINT * 60000000 AS bar_end FROM bars JOIN timeframes USING (tf) WHERE minutes > 0), q AS (SELECT quote_id, root, {PAIR} AS pair, tf, epoch_us(quote_time) AS at FROM quotes WHERE quote_time IS NOT NULL)"
ASOF = "q ASOF LEFT JOIN ended b ON q.root = b.root AND q.pair = b.pair AND q.tf = b.tf AND q.at >= b.bar_end"


@query("asof_price", f"WITH {ENDED} SELECT quote_id, b.close AS close, b.bar_end AS as_of FROM {ASOF}")
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price at an origin: the last bar that had ended by then."""
    return J.asof(quotes_of(spark, sf_dir), ended(spark, sf_dir), SERIES, "at", "bar_end", ["close"], width=MONTH_US).select("quote_id", "close", "as_of")


@query("asof_tolerance", f"WITH {ENDED} SELECT quote_id, CASE WHEN q.at - b.bar_end <= 10800000000 THEN b.close END AS close FROM {ASOF}")
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.asof(quotes_of(spark, sf_dir), ended(spark, sf_dir), SERIES, "at", "bar_end", ["close"], tolerance=10_800_000_000, width=MONTH_US).select("quote_id", "close")


@query("asof_strict", f"WITH {ENDED} SELECT quote_id, b.close AS close FROM {ASOF.replace('q.at >= b.bar_end', 'q.at > b.bar_end')}")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.asof(quotes_of(spark, sf_dir), ended(spark, sf_dir), SERIES, "at", "bar_end", ["close"], strict=True, width=MONTH_US).select("quote_id", "close")


@query("outcome_join", f"""WITH {ENDED}, t AS (SELECT quote_id, root, pair, tf, q.at AS at, q.at + 4 * minutes::BIGINT * 60000000 AS target FROM q JOIN timeframes USING (tf)),
m AS (SELECT root, pair, tf, max(bar_end) AS reach FROM ended GROUP BY ALL)
SELECT t.quote_id, CASE WHEN b.bar_end > t.at THEN b.close END AS actual FROM t ASOF LEFT JOIN ended b ON t.root = b.root AND t.pair = b.pair AND t.tf = b.tf AND t.target >= b.bar_end
JOIN m ON t.root = m.root AND t.pair = m.pair AND t.tf = m.tf WHERE reach >= target""")
def outcome_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome four bars later: the last bar ended by the target and after the origin, else void; only where data reach the target."""
    minutes = small(table(spark, sf_dir, "timeframes").select("tf", "minutes"))
    asked = quotes_of(spark, sf_dir).join(minutes, "tf").withColumn("target", F.col("at") + 4 * F.col("minutes").cast("long") * 60_000_000)
    bars = ended(spark, sf_dir)
    reach = bars.groupBy(*SERIES).agg(F.max("bar_end").alias("reach"))
    met = J.asof(asked.select("quote_id", *SERIES, "at", "target"), bars, SERIES, "target", "bar_end", ["close"], width=MONTH_US)
    return met.join(reach, SERIES).where(F.col("reach") >= F.col("target")).select("quote_id", F.when(F.col("as_of") > F.col("at"), F.col("close")).alias("actual"))


RATE_AT = "r AS (SELECT root, cur, freq, epoch_us(CAST(obs_date AS TIMESTAMP) + CASE freq WHEN 'm' THEN INTERVAL 2 MONTH ELSE INTERVAL 1 DAY END) AS known, max(value) AS value FROM rates WHERE value IS NOT NULL GROUP BY ALL)"


@query("asof_lagged_source", f"""WITH d AS (SELECT line_id, root, substr({PAIR}, 1, 3) AS cur, epoch_us(bar_time) AS at FROM prices WHERE tf = '1d'), {RATE_AT}
SELECT d.line_id, coalesce(x.value, y.value) AS rate FROM d ASOF LEFT JOIN (SELECT * FROM r WHERE freq = 'd') x ON d.root = x.root AND d.cur = x.cur AND d.at >= x.known
ASOF LEFT JOIN (SELECT * FROM r WHERE freq = 'm') y ON d.root = y.root AND d.cur = y.cur AND d.at >= y.known""")
def asof_lagged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of the base currency: monthly figures known two months later, daily ones a day later; daily ones come first."""
    bars = table(spark, sf_dir, "prices").where(F.col("tf") == "1d")
    asked = bars.select("line_id", "root", F.substring(plain_pair(F.col("pair")), 1, 3).alias("cur"), micros(F.col("bar_time")).alias("at"))
    lag = F.when(F.col("freq") == "m", F.add_months("obs_date", 2)).otherwise(F.date_add("obs_date", 1))
    known = table(spark, sf_dir, "rates").where(F.col("value").isNotNull()).select("root", "cur", "freq", "value", (F.unix_date(lag).cast("long") * DAY_US).alias("known"))
    first = J.asof(asked, known.where("freq = 'd'").withColumnRenamed("value", "daily"), ["root", "cur"], "at", "known", ["daily"], width=12 * MONTH_US).drop("as_of")
    both = J.asof(first, known.where("freq = 'm'").withColumnRenamed("value", "monthly"), ["root", "cur"], "at", "known", ["monthly"], width=12 * MONTH_US)
    return both.select("line_id", F.coalesce("daily", "monthly").alias("rate"))


@query("rate_difference", f"""WITH e AS (SELECT line_id, root, bar_time, unnest([substr({PAIR}, 1, 3), substr({PAIR}, 4, 3)]) AS cur, unnest([1, -1]) AS sign FROM prices WHERE tf = '1d'),
k AS (SELECT line_id, sign, value, row_number() OVER (PARTITION BY line_id, sign ORDER BY obs_date DESC, r.fetched_at DESC, rate_id DESC) AS n FROM e JOIN rates r ON r.root = e.root AND r.cur = e.cur AND value IS NOT NULL
 AND obs_date <= CAST(bar_time AS DATE) AND r.fetched_at < bar_time + INTERVAL 1 DAY)
SELECT line_id, round(sum(sign * value), 4) AS diff FROM k WHERE n = 1 GROUP BY line_id HAVING count(*) = 2""")
def rate_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base minus quote rate known at the bar's end; left out where either is unknown."""
    from quillon.operators.known_at import rates_at_bars

    prices = table(spark, sf_dir, "prices")
    base = prices.where("tf = '1d'").select("line_id", F.substring(plain_pair(F.col("pair")), 1, 3).alias("base"))
    known = rates_at_bars(prices, table(spark, sf_dir, "rates")).join(base, "line_id")
    sign = F.when(F.col("cur") == F.col("base"), 1).otherwise(-1)
    return known.groupBy("line_id").agg(F.sum(sign * F.col("value")).alias("d"), F.count(F.lit(1)).alias("n")).where("n = 2").select("line_id", F.round(F.col("d"), 4).alias("diff"))


@query("nway_common_hours", f"WITH {BARS}, b AS (SELECT *, pair || ' ' || tf AS series FROM bars WHERE tf <> '1d'), k AS (SELECT root, count(DISTINCT series) AS n FROM b GROUP BY root), e AS (SELECT root, bar_time, count(DISTINCT series) AS n FROM b GROUP BY ALL) SELECT root, strftime(bar_time, '%Y-%m-%d %H:%M:%S') AS bar_time, n AS series FROM e JOIN k USING (root, n)")
def nway_common_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants at which every intraday series of a root has a bar."""
    bars = bars_of(spark, sf_dir).where("tf <> '1d'").withColumn("series", F.concat_ws(" ", "pair", "tf"))
    return J.common(bars, ["root"], "series", "bar_time").select("root", stamp(), F.col("n").alias("series"))


@query("left_align", f"""WITH {BARS}, r AS (SELECT root, pair, CAST(bar_time AS DATE) AS day, ln(close / lag(close) OVER ({W})) AS x FROM bars WHERE tf = '1h'), u AS (SELECT root, pair, day, sum(x * x) AS rv FROM r GROUP BY ALL), v AS (SELECT pair, day, avg(rv) AS rv FROM u GROUP BY ALL)
SELECT {KEY}, round(rv, 10) AS rv FROM bars d LEFT JOIN v ON v.pair = d.pair AND v.day = CAST(d.bar_time AS DATE) WHERE tf = '1d'""".replace(KEY, "d.root AS root, d.pair AS pair, d.tf AS tf, strftime(d.bar_time, '%Y-%m-%d %H:%M:%S') AS bar_time"))
def left_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly variance of a pair, its mean over the roots that have hourly bars, aligned to every root's daily bars."""
    bars = bars_of(spark, sf_dir)
    moved = bars.where("tf = '1h'").withColumn("x", B.log_return_bp() / 10_000)
    rv = moved.groupBy("root", "pair", F.to_date("bar_time").alias("day")).agg(F.sum(F.col("x") * F.col("x")).alias("rv"))
    rv = rv.groupBy("pair", "day").agg(F.avg("rv").alias("rv"))
    daily = bars.where("tf = '1d'").withColumn("day", F.to_date("bar_time"))
    return shown(daily.join(rv, ["pair", "day"], "left"), ["rv"], 10)


@query("densify_calendar", f"""WITH {BARS}, d AS (SELECT root, pair, CAST(bar_time AS DATE) AS day, count(*) AS bars FROM bars WHERE tf = '1h' GROUP BY ALL), e AS (SELECT root, pair, min(day) AS a, max(day) AS z FROM d GROUP BY ALL),
c AS (SELECT root, pair, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM e) SELECT root, pair, strftime(day, '%Y-%m-%d') AS day, coalesce(bars, 0) AS bars FROM c LEFT JOIN d USING (root, pair, day) WHERE isodow(day) <= 5""")
def densify_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars_of(spark, sf_dir).where("tf = '1h'").groupBy("root", "pair", F.to_date("bar_time").alias("day")).agg(F.count(F.lit(1)).alias("bars"))
    return J.dense(days, ["root", "pair"], "day", ["bars"]).select("root", "pair", F.date_format("day", "yyyy-MM-dd").alias("day"), "bars")


@query("anti_pending", f"WITH {ENDED} SELECT quote_id FROM q JOIN timeframes USING (tf) WHERE NOT EXISTS (SELECT 1 FROM ended b WHERE b.root = q.root AND b.pair = q.pair AND b.tf = q.tf AND b.bar_end > q.at + minutes::BIGINT * 24 * 60000000)")
def anti_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes whose outcome 24 bars later is not known yet: no bar has ended after that."""
    reach = ended(spark, sf_dir).groupBy(*SERIES).agg(F.max("bar_end").alias("reach"))
    asked = quotes_of(spark, sf_dir).join(lengths(table(spark, sf_dir, "timeframes")), "tf")
    met = asked.join(reach, SERIES).where(F.col("reach") > F.col("at") + 24 * F.col("length"))
    return asked.join(met.select("quote_id"), "quote_id", "left_anti").select("quote_id")


@query("semi_known", "SELECT rate_id FROM rates WHERE (root, cur) IN (SELECT root, cur FROM rates WHERE freq = 'd')")
def semi_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "rates")
    return rates.join(rates.where("freq = 'd'").select("root", "cur").distinct(), ["root", "cur"], "left_semi").select("rate_id")


@query("interval_event_join", f"""WITH {ENDED}, s AS (SELECT root, pair, tf, bar_end - minutes::BIGINT * 60000000 AS a, bar_end AS z, close FROM ended JOIN timeframes USING (tf))
SELECT quote_id, s.a // 1000000 AS step_start, s.close AS close FROM q JOIN s ON q.root = s.root AND q.pair = s.pair AND q.tf = s.tf AND q.at >= s.a AND q.at < s.z""")
def interval_event_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with the bar whose span [start, end) holds them."""
    spans = ended(spark, sf_dir).select(*SERIES, (F.col("bar_end") - F.col("minutes").cast("long") * 60_000_000).alias("a"), F.col("bar_end").alias("z"), "close")
    return J.within(quotes_of(spark, sf_dir).drop("price"), spans, SERIES, "at", "a", "z", 3_600_000_000).select("quote_id", (F.col("a") / 1_000_000).cast("long").alias("step_start"), "close")


@query("window_join_48h", """WITH o AS (SELECT event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'), h AS (SELECT event_id AS h, epoch_us(ts) AS at FROM events WHERE event_type = 'signup')
SELECT o.event_id, count(h.h) AS before FROM o LEFT JOIN h ON h.at >= o.at - 172800000000 AND h.at < o.at GROUP BY o.event_id""")
def window_join_48h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the signups of the 48 hours before it: a range count over one ordered stream."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup")).withColumn("at", micros(F.col("ts")))
    signups = e.where("event_type = 'signup'").select("at")
    asked = e.where("event_type = 'purchase'").select("event_id", "at")
    return J.counted_before(signups, asked, "event_id", "at", 172_800_000_000, 3_600_000_000).select("event_id", F.col("n").alias("before"))


@query("range_count", f"""WITH {BARS}, d AS (SELECT DISTINCT root, pair, epoch_us(bar_time) AS at FROM bars WHERE tf = '1h'), q AS (SELECT quote_id, root, {PAIR} AS pair, epoch_us(quote_time) AS at FROM quotes WHERE quote_time IS NOT NULL)
SELECT quote_id, count(d.at) AS hours FROM q LEFT JOIN d ON d.root = q.root AND d.pair = q.pair AND d.at > q.at - 86400000000 AND d.at <= q.at GROUP BY quote_id""")
def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars in the day before each quote."""
    hours = bars_of(spark, sf_dir).where("tf = '1h'").select("root", "pair", micros(F.col("bar_time")).alias("h"))
    asked = quotes_of(spark, sf_dir).select("quote_id", "root", "pair", (F.col("at") + 1).alias("at"))
    return J.counted_before(hours, asked, "quote_id", "at", DAY_US, MONTH_US, ["root", "pair"], "h").select("quote_id", F.col("n").alias("hours"))


@query("outer_index_union", f"""WITH {BARS}, b AS (SELECT root, pair, bar_time, close FROM bars WHERE tf = '1h'), i AS (SELECT DISTINCT root, bar_time FROM b), p AS (SELECT DISTINCT root, pair FROM b), g AS (SELECT * FROM i JOIN p USING (root)),
j AS (SELECT g.*, close FROM g LEFT JOIN b USING (root, pair, bar_time)) SELECT root, pair, strftime(bar_time, '%Y-%m-%d %H:%M:%S') AS bar_time, last_value(close IGNORE NULLS) OVER (PARTITION BY root, pair ORDER BY bar_time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close FROM j""")
def outer_index_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a root on the union of the root's hours, values carried forward over at most three hours."""
    b = bars_of(spark, sf_dir).where("tf = '1h'").select("root", "pair", "bar_time", "close")
    grid = b.select("root", "bar_time").distinct().join(b.select("root", "pair").distinct(), "root")
    w = Window.partitionBy("root", "pair").orderBy("bar_time").rowsBetween(-3, 0)
    return grid.join(b, ["root", "pair", "bar_time"], "left").select("root", "pair", stamp(), F.last("close", ignorenulls=True).over(w).alias("close"))


@query("parameter_grid", f"""WITH {BARS}, r AS (SELECT root, pair, tf, bar_time, close, lag(close) OVER ({W}) AS p FROM bars), x AS (SELECT *, abs(ln(close / p)) * 10000 AS m FROM r WHERE p IS NOT NULL)
SELECT tf, t.stop AS stop, t.hold AS hold, count(*) AS n, count(*) FILTER (m > t.stop * t.hold) AS beyond FROM x CROSS JOIN (SELECT unnest([5.0, 10.0, 20.0, 5.0, 10.0, 20.0]) AS stop, unnest([1, 1, 1, 4, 4, 4]) AS hold) t GROUP BY ALL""")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves beyond each stop and holding period of a fixed grid; the grid is unfolded in the row, not joined."""
    moves = bars_of(spark, sf_dir).withColumn("m", F.abs(B.log_return_bp())).where(F.col("m").isNotNull())
    grid = F.array(*(F.struct(F.lit(s).alias("stop"), F.lit(h).alias("hold")) for s in (5.0, 10.0, 20.0) for h in (1, 4)))
    return moves.select("tf", "m", F.inline(grid)).groupBy("tf", "stop", "hold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("m") > F.col("stop") * F.col("hold")).alias("beyond"))


@query("set_union", "SELECT DISTINCT cur FROM (SELECT base AS cur FROM fx_pairs UNION SELECT quote FROM fx_pairs UNION SELECT cur FROM rates)")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "fx_pairs")
    return p.select(F.col("base").alias("cur")).union(p.select("quote")).union(table(spark, sf_dir, "rates").select("cur")).distinct()


@query("set_intersect", f"SELECT DISTINCT {PAIR} AS pair FROM prices WHERE tf = '15m' INTERSECT SELECT DISTINCT {PAIR} FROM prices WHERE tf = '1d'")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "prices").select("tf", plain_pair(F.col("pair")).alias("pair"))
    return p.where("tf = '15m'").select("pair").intersect(p.where("tf = '1d'").select("pair"))


@query("set_except", f"SELECT code AS pair FROM fx_pairs EXCEPT SELECT DISTINCT {PAIR} FROM quotes")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fx_pairs").select(F.col("code").alias("pair")).exceptAll(table(spark, sf_dir, "quotes").select(plain_pair(F.col("pair")).alias("pair")).distinct())


@query("set_equality", f"WITH a AS (SELECT DISTINCT {PAIR} AS p FROM prices), b AS (SELECT code AS p FROM fx_pairs) SELECT (SELECT count(*) FROM (SELECT p FROM a EXCEPT SELECT p FROM b)) AS only_prices, (SELECT count(*) FROM (SELECT p FROM b EXCEPT SELECT p FROM a)) AS only_codes")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "prices").select(plain_pair(F.col("pair")).alias("p")).distinct().withColumn("in_a", F.lit(1))
    b = table(spark, sf_dir, "fx_pairs").select(F.col("code").alias("p")).withColumn("in_b", F.lit(1))
    return a.join(b, "p", "full").agg(F.count_if(F.col("in_b").isNull()).alias("only_prices"), F.count_if(F.col("in_a").isNull()).alias("only_codes"))


@query("topn_latest", f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY root, pair, tf ORDER BY bar_time DESC) AS n FROM bars) SELECT {KEY}, close FROM r WHERE n <= 5")
def topn_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest bars of each series (the limit is the feature)."""
    w = Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())
    return shown(bars_of(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 5"), ["close"])


@query("latest_per_key", "SELECT root, sid, arg_max(value, (obs_date, fetched_at, rate_id)) AS value FROM rates WHERE value IS NOT NULL AND fetched_at IS NOT NULL GROUP BY root, sid")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rates").where(F.col("value").isNotNull() & F.col("fetched_at").isNotNull())
    return r.groupBy("root", "sid").agg(F.max_by("value", F.struct("obs_date", "fetched_at", "rate_id")).alias("value"))


@query("known_before", "SELECT rate_id FROM rates WHERE fetched_at < TIMESTAMP '2024-01-01'")
def known_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rates").where(F.col("fetched_at") < F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).select("rate_id")


@query("new_rows", f"WITH {BARS}, l AS (SELECT root, pair, tf, max(bar_time) FILTER (bar_time < TIMESTAMP '2024-01-01') AS last FROM bars GROUP BY ALL) SELECT {KEY} FROM bars JOIN l USING (root, pair, tf) WHERE last IS NULL OR bar_time > last")
def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars newer than the last one of a store of 2024-01-01 (append only: late bars stay out)."""
    bars = bars_of(spark, sf_dir)
    stored = F.when(F.col("bar_time") < F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.col("bar_time"))
    last = bars.groupBy(*SERIES).agg(F.max(stored).alias("last"))
    return shown(bars.join(last, SERIES).where(F.col("last").isNull() | (F.col("bar_time") > F.col("last"))), [])


@query("stratified_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each source in an order drawn by a hash (a sampling operator)."""
    w = Window.partitionBy(F.lower(F.trim("source"))).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(w).alias("n")).where("n <= 20").select("doc_id")


@query("total_order", "SELECT quote_id, CAST(row_number() OVER (ORDER BY quote_time, root, quote_id) AS BIGINT) AS place FROM quotes WHERE quote_time IS NOT NULL")
def total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each quote in the total order."""
    q = table(spark, sf_dir, "quotes").where(F.col("quote_time").isNotNull())
    return J.numbered(q, [], F.to_date("quote_time"), ["quote_time", "root", "quote_id"], "place").select("quote_id", "place")


@query("interpolated_price", f"WITH {ENDED}, a AS (SELECT quote_id, q.root, q.pair, q.tf, q.at AS since, b.bar_end AS a0, b.close AS u0 FROM {ASOF}), z AS (SELECT a.*, n.bar_end AS a1, n.close AS u1 FROM a ASOF LEFT JOIN ended n ON a.root = n.root AND a.pair = n.pair AND a.tf = n.tf AND a.since <= n.bar_end) SELECT quote_id, CASE WHEN u0 IS NULL THEN u1 WHEN u1 IS NULL THEN u0 WHEN a1 = a0 THEN u0 ELSE u0 + (u1 - u0) * ((since - a0) / (a1 - a0)::DOUBLE) END AS close FROM z")
def interpolated_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price at each quote's instant, linear between the closes before and after it."""
    q = quotes_of(spark, sf_dir).drop("price")
    return J.interpolated(q, ended(spark, sf_dir), SERIES, "at", "bar_end", "close", MONTH_US).select("quote_id", "close")


@query("first_usable", f"WITH {BARS}, s AS (SELECT pair, bar_time, close, CASE tf WHEN '1h' THEN 0 WHEN '15m' THEN 1 ELSE 2 END AS source FROM bars), n AS (SELECT pair, source, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 300), f AS (SELECT pair, min(source) AS source FROM n GROUP BY pair) SELECT pair, source, count(*) AS bars, round(sum(close), 6) AS closes FROM s JOIN f USING (pair, source) GROUP BY pair, source")
def first_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each pair from the first timeframe that has 300 of them."""
    bars = bars_of(spark, sf_dir)
    chosen = J.first_usable([bars.where(F.col("tf") == tf).select("pair", "bar_time", "close") for tf in ("1h", "15m", "1d")], ["pair"], 300)
    return chosen.groupBy("pair", "source").agg(F.count(F.lit(1)).alias("bars"), F.round(F.sum("close"), 6).alias("closes"))
