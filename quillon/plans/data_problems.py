"""Queries of the general training-data problems (1, 2, 3 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators import implausible, known_at, regular_grid, rolling_totals
from quillon.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_totals.thin_days(table(spark, sf_dir, "prices"))


def p1_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_totals.trailing_bars(table(spark, sf_dir, "prices"), table(spark, sf_dir, "timeframes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible.judged(table(spark, sf_dir, "prices"), table(spark, sf_dir, "timeframes")).select("line_id")


def p2_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = implausible.judged(table(spark, sf_dir, "prices"), table(spark, sf_dir, "timeframes"))
    return flagged.select("line_id", "state", F.round("p_spike", 6).alias("p_spike"), F.round("p_stuck", 6).alias("p_stuck"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_at.rates_at_bars(table(spark, sf_dir, "prices"), table(spark, sf_dir, "rates")).select("line_id", "cur", "rate_id")


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_at.rates_at_bars(table(spark, sf_dir, "prices"), table(spark, sf_dir, "rates"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid.quote_grid(table(spark, sf_dir, "quotes"), table(spark, sf_dir, "timeframes"))
    return grid.where("missing").select("root", "pair", "tf", "slot")


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid.quote_grid(table(spark, sf_dir, "quotes"), table(spark, sf_dir, "timeframes"))
    return grid.withColumns({"value": F.round("value", 6), "sd": F.round("sd", 8)})


QUERIES = {"p1_found": p1_found, "p1_trailing": p1_trailing, "p2_found": p2_found, "p2_states": p2_states, "p3_found": p3_found, "p3_values": p3_values, "p5_found": p5_found, "p5_grid": p5_grid}

PAIR = "upper(replace(replace(pair, '/', ''), '_', ''))"

DAYS = f"""
bars AS (SELECT DISTINCT root, {PAIR} AS pair, tf, bar_time FROM prices WHERE close IS NOT NULL AND bar_time IS NOT NULL),
daily AS (SELECT root, pair, tf, CAST(bar_time AS DATE) AS d, count(*) AS n FROM bars GROUP BY ALL),
spans AS (SELECT root, pair, tf, min(d) AS a, max(d) AS z FROM daily GROUP BY ALL),
calendar AS (SELECT root, pair, tf, a, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS d FROM spans)"""

KNOWN = f"""
WITH e AS (SELECT line_id, root, bar_time, unnest([substr({PAIR}, 1, 3), substr({PAIR}, 4, 3)]) AS cur FROM prices WHERE tf = '1d' AND bar_time IS NOT NULL),
ranked AS (SELECT line_id, e.cur, rate_id, sid, value,
  row_number() OVER (PARTITION BY line_id, e.cur ORDER BY obs_date DESC, r.fetched_at DESC, rate_id DESC) AS k
  FROM e JOIN rates r ON r.root = e.root AND r.cur = e.cur AND r.value IS NOT NULL
  AND r.obs_date <= CAST(e.bar_time AS DATE) AND r.fetched_at < e.bar_time + INTERVAL 1 DAY)"""

ORACLE = {
    "p1_found": f"""WITH {DAYS},
dense AS (SELECT c.*, coalesce(n, 0) AS n FROM calendar c LEFT JOIN daily USING (root, pair, tf, d)),
rolled AS (SELECT *, sum(n) OVER (PARTITION BY root, pair, tf ORDER BY d ROWS 6 PRECEDING) AS c7,
  sum(n) OVER (PARTITION BY root, pair, tf ORDER BY d ROWS 29 PRECEDING) AS c30 FROM dense)
SELECT root, pair, tf, strftime(d, '%Y-%m-%d') AS day FROM rolled WHERE d >= a + 29 AND 60 * c7 < 7 * c30""",
    "p1_trailing": f"""WITH latest AS (SELECT root, {PAIR} AS pair, tf, bar_time, coalesce(high - low, 0.0) AS span,
  row_number() OVER (PARTITION BY root, {PAIR}, tf, bar_time ORDER BY fetched_at DESC NULLS LAST, line_id DESC) AS k
  FROM prices WHERE close IS NOT NULL AND bar_time IS NOT NULL),
daily AS (SELECT root, pair, tf, CAST(bar_time AS DATE) AS d, count(*) AS n, sum(span) AS span FROM latest WHERE k = 1 GROUP BY ALL),
spans AS (SELECT root, pair, tf, min(d) AS a, max(d) AS z FROM daily GROUP BY ALL),
calendar AS (SELECT root, pair, tf, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS d FROM spans),
periods AS (SELECT DISTINCT tf, days FROM (SELECT tf, unnest(list_concat([7, 30], horizons)) AS days FROM timeframes)),
rolled AS (SELECT c.root, c.pair, c.tf, c.d, p.days, coalesce(sum(n), 0) AS bars, coalesce(sum(span), 0.0) AS span
  FROM calendar c JOIN periods p USING (tf)
  LEFT JOIN daily x ON x.root = c.root AND x.pair = c.pair AND x.tf = c.tf AND x.d <= c.d AND x.d > c.d - p.days GROUP BY ALL)
SELECT root, pair, tf, strftime(d, '%Y-%m-%d') AS day, days, CAST(bars AS BIGINT) AS bars, round(span, 6) AS span_total,
  round(bars / days, 9) AS bars_a_day, round(span / days, 9) AS span_a_day FROM rolled""",
    "p3_found": f"{KNOWN} SELECT line_id, cur, rate_id FROM ranked WHERE k = 1",
    "p3_values": f"{KNOWN} SELECT line_id, cur, rate_id, sid, value FROM ranked WHERE k = 1",
    "p5_found": f"""WITH r AS (SELECT root, {PAIR} AS pair, tf, CAST(minutes AS BIGINT) * 60 AS w, epoch_us(quote_time) // (CAST(minutes AS BIGINT) * 60000000) AS s
  FROM quotes JOIN timeframes USING (tf) WHERE quote_time IS NOT NULL AND price IS NOT NULL AND minutes > 0),
ends AS (SELECT root, pair, tf, w, min(s) AS a, max(s) AS z FROM r GROUP BY ALL),
slots AS (SELECT root, pair, tf, w, unnest(generate_series(a, z)) AS s FROM ends)
SELECT root, pair, tf, s * w AS slot FROM slots ANTI JOIN r USING (root, pair, tf, s)""",
}
