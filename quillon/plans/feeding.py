"""Queries of the payload parsers, the append-only stores and the streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.plans.shared import BARS, KEY, Registry, bars_of, shown, stamp
from quillon.session import shared_folder
from quillon.sources import feeds, stores
from quillon.sources.tables import SERIES, table
from quillon.streaming import pipeline as Z

query = Registry()
QUERIES, ORACLE = query.queries, query.sql


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


# --- payloads -------------------------------------------------------------------------------------------------------


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart payloads of the hourly bars, one a series and day, with columnar arrays of prices."""
    hours = bars_of(spark, sf_dir).where("tf = '1h'").withColumn("at", F.unix_seconds(F.to_utc_timestamp(F.col("bar_time").cast("timestamp"), "UTC")))
    days = hours.groupBy("root", "pair", F.to_date("bar_time").alias("day")).agg(F.array_sort(F.collect_list(F.struct("at", "open", "high", "low", "close"))).alias("b"))
    quote = F.array(F.struct(*(F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close"))))
    meta = F.struct(F.lit("UTC").alias("exchangeTimezoneName"), F.element_at("b.close", -1).alias("regularMarketPrice"))
    result = F.array(F.struct(meta.alias("meta"), F.col("b.at").alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators")))
    return days.select(F.concat_ws("/", "root", "pair").alias("key"), F.to_json(F.struct(F.struct(result.alias("result")).alias("chart"))).alias("payload"))


CHART_SQL = f"WITH {BARS} SELECT root || '/' || pair AS key, epoch_us(bar_time) // 1000000 AS at, open, high, low, close FROM bars WHERE tf = '1h'"


@query("chart_bars", CHART_SQL)
def chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.chart_bars(charts(spark, sf_dir), "key", "payload").drop("zone")


@query("intraday_chart", f"{CHART_SQL} AND bar_time + INTERVAL 1 HOUR + INTERVAL 3 MINUTE <= TIMESTAMP '2024-06-01 12:00:00'")
def intraday_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the payloads that had ended and settled at a cutoff."""
    return feeds.intraday_chart(charts(spark, sf_dir), "key", "payload", 1_717_243_200, 60)


@query("flat_rates", f"WITH {BARS} SELECT strftime(bar_time, '%Y-%m-%d') AS day, close AS open, close AS high, close AS low, close FROM bars WHERE tf = '1d'")
def flat_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat daily bars of payloads of rates by date, one a series and year."""
    daily = bars_of(spark, sf_dir).where("tf = '1d'")
    by_day = F.map_from_entries(F.collect_list(F.struct(F.date_format("bar_time", "yyyy-MM-dd"), F.map_from_arrays(F.array(F.lit("USD")), F.array("close")))))
    payloads = daily.groupBy("root", "pair", F.year("bar_time")).agg(F.to_json(F.struct(by_day.alias("rates"))).alias("p"))
    return feeds.flat_rates(payloads, "p", "USD").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("rate_rows", "SELECT strftime(obs_date, '%Y-%m-%d') AS obs_date, value FROM rates WHERE value IS NOT NULL AND rate_id % 10 <> 3")
def rate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of written rates; every tenth is a dot, as the publisher writes a missing value."""
    written = table(spark, sf_dir, "rates").select(F.concat_ws(",", F.date_format("obs_date", "yyyy-MM-dd"), F.when(F.col("rate_id") % 10 == 3, ".").otherwise(F.coalesce(F.col("value").cast("string"), F.lit("")))).alias("line"))
    parsed = written.select(F.from_csv("line", "date string, value string").alias("r")).select("r.*")
    return feeds.rate_rows(parsed).withColumn("obs_date", F.date_format("obs_date", "yyyy-MM-dd"))


FIRST = "trim(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END, ' ')"
HEADS = f"h AS (SELECT doc_id, {FIRST} AS title, coalesce(publisher, '') AS publisher, date_trunc('second', published_at) AS published FROM documents WHERE text IS NOT NULL AND published_at IS NOT NULL), i AS (SELECT * FROM h WHERE regexp_full_match(title, '[A-Za-z0-9,.:/%-]+( [A-Za-z0-9,.:/%-]+)*'))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items parsed from feeds made of the documents' plain headlines: mail dates, escapes, publishers at the end of titles."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("published_at").isNotNull())
    h = d.select("doc_id", F.trim(F.substring_index("text", "\n", 1)).alias("t"), F.coalesce("publisher", F.lit("")).alias("p"), "published_at").where(F.col("t").rlike(r"^[A-Za-z0-9,.:/%-]+( [A-Za-z0-9,.:/%-]+)*\z"))
    when = F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    end = F.when(F.col("p") != "", F.concat(F.lit(" - "), "p")).otherwise("")
    item = F.concat(F.lit("<item><title><![CDATA["), "t", end, F.lit("]]></title><link>http://news/"), F.col("doc_id").cast("string"), F.lit("</link><pubDate>"), when, F.lit("</pubDate><source url=\"x\">"), "p", F.lit("</source></item>"))
    feed = F.concat(F.lit("<rss><channel><title>all</title>"), item, F.lit("</channel></rss>"))
    return feeds.feed_items(h.select(F.col("doc_id").alias("key"), feed.alias("p")), "key", "p")


@query("feed_items", f"WITH {HEADS} SELECT doc_id AS key, CASE WHEN publisher <> '' THEN title || ' - ' || publisher ELSE title END AS title, 'http://news/' || doc_id AS link, publisher FROM i")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("key", "title", "link", "publisher")


NORMAL = f"{HEADS}, n AS (SELECT substr(sha256(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), 1, 16) AS id, substr(title, 1, 300) AS title, publisher, doc_id, least(published, TIMESTAMP '2024-06-01') AS since FROM i WHERE published >= TIMESTAMP '2024-03-01')"


@query("normalised_items", f"WITH {NORMAL} SELECT id, title, publisher, strftime(since, '%Y-%m-%d %H:%M:%S') AS published_at FROM n")
def normalised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the 92 days before an instant, clamped to it, with ids of their plain titles."""
    kept = feeds.normalised(items(spark, sf_dir), F.lit("2024-06-01 00:00:00").cast("timestamp"), 92)
    return kept.select("id", "title", "publisher", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("first_seen_items", f"WITH {NORMAL} SELECT id, strftime(min(since), '%Y-%m-%d %H:%M:%S') AS published_at, count(*) AS copies FROM n GROUP BY id")
def first_seen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item an id, the first published, and how many came."""
    kept = feeds.normalised(items(spark, sf_dir), F.lit("2024-06-01 00:00:00").cast("timestamp"), 92)
    first = feeds.first_seen(kept).select("id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))
    return first.join(kept.groupBy("id").agg(F.count(F.lit(1)).alias("copies")), "id")


# --- stores ---------------------------------------------------------------------------------------------------------

STORED = f"WITH {BARS}, o AS (SELECT * FROM bars WHERE bar_time < TIMESTAMP '2024-01-01'), l AS (SELECT root, pair, tf, max(bar_time) AS last FROM o GROUP BY ALL)"


@query("store_bars", f"{STORED} SELECT {KEY}, close FROM o UNION ALL SELECT {KEY}, close FROM bars LEFT JOIN l USING (root, pair, tf) WHERE (last IS NULL OR bar_time > last) AND (last IS NOT NULL OR bar_time >= TIMESTAMP '2024-01-01')")
def store_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after the bars before 2024 were added, then all bars: nothing twice, nothing late."""
    path, bars = fresh(spark, "bars"), bars_of(spark, sf_dir)
    early = F.col("bar_time") < F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    stores.append_new_bars(bars.where(early), path)
    stores.append_new_bars(bars, path)
    return shown(spark.read.parquet(path), ["close"], 9)


EARLY, LATE = "fetched_at < TIMESTAMP '2024-01-01'", "fetched_at >= TIMESTAMP '2024-01-01'"
ITEMS = "(SELECT md5(lower(trim(source)) || CAST(n_chars % 50 AS VARCHAR)) AS id, min(fetched_at) AS seen FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL AND {when} GROUP BY 1)"
SEEN = "strftime({x}.seen, '%Y-%m-%d %H:%M:%S') AS fetched_at"


@query("store_items", f"WITH a AS {ITEMS.format(when=EARLY)}, b AS {ITEMS.format(when=LATE)} SELECT id, {SEEN.format(x='a')} FROM a UNION ALL SELECT id, {SEEN.format(x='b')} FROM b LEFT JOIN a USING (id) WHERE a.seen IS NULL OR a.seen < b.seen - INTERVAL 62 DAY")
def store_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of items after two rounds; an id comes again only after 62 days."""
    path = fresh(spark, "items")
    d = table(spark, sf_dir, "documents").where(F.col("source").isNotNull() & F.col("n_chars").isNotNull() & F.col("fetched_at").isNotNull())
    found = d.select(F.md5(F.concat(F.lower(F.trim("source")), (F.col("n_chars") % 50).cast("string")).cast("binary")).alias("id"), "fetched_at")
    early = F.col("fetched_at") < F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    stores.append_new_items(found.withColumn("seen", F.lit(1)).where(early), path)
    stores.append_new_items(found.withColumn("seen", F.lit(1)).where(~early), path)
    return spark.read.parquet(path).select("id", stamp("fetched_at"))


@query("store_since", "SELECT doc_id AS id, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM documents WHERE fetched_at >= TIMESTAMP '2024-05-10'")
def store_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored items from a day on; older months aren't read."""
    path = fresh(spark, "since")
    stores.append_new_items(table(spark, sf_dir, "documents").where(F.col("fetched_at").isNotNull()).select(F.col("doc_id").alias("id"), "fetched_at", F.lit(1).alias("seen")), path)
    return stores.items_since(spark, path, "2024-05-10").select("id", stamp("fetched_at"))


# --- streams --------------------------------------------------------------------------------------------------------


def streamed(spark: SparkSession, sf_dir: str, made: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """What a stream over the events has put out when all that is there was taken; closed windows only.

    The pattern lets the table be a file or a folder of files.
    """
    path, schema = f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema
    out, state = fresh(spark, "stream"), fresh(spark, "state")
    read = lambda: Z.ticks(spark, path, schema, "ts")
    stream = made(read)
    Z.drained(stream, out, state).awaitTermination()
    try:
        return spark.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*").select(*stream.columns)
    except Exception as e:  # no batch had a row
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)


WATER = "m AS (SELECT max(ts) AS top FROM events)"


@query("stream_tumbling", f"WITH {WATER}, w AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS b, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY ALL) SELECT event_type, strftime(b, '%Y-%m-%d %H:%M:%S') AS bar_time, open, high, low, close, ticks FROM w, m WHERE b + INTERVAL 15 MINUTE <= top - INTERVAL 3 MINUTE")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hour bars of a stream, put out three minutes after their end."""
    df = streamed(spark, sf_dir, lambda read: Z.tumbling_bars(read(), "event_type", "ts", "value", "event_id", "15 minutes"))
    return df.withColumn("bar_time", F.date_format("bar_time", "yyyy-MM-dd HH:mm:ss"))


@query("stream_sliding", f"WITH {WATER}, e AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) + INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) + INTERVAL 4 HOUR]) + INTERVAL 2 HOUR AS z FROM events), s AS (SELECT event_type, z, round(sum(value), 6) AS total, count(*) AS n FROM e GROUP BY ALL) SELECT event_type, strftime(z, '%Y-%m-%d %H:%M:%S') AS ends, total, n FROM s, m WHERE z <= top - INTERVAL 1 MINUTE")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of six hours every two hours."""
    df = streamed(spark, sf_dir, lambda read: Z.sliding_sums(read(), "event_type", "ts", "value", "6 hours", "2 hours", "1 minute"))
    return df.select("event_type", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("ends"), F.round("total", 6).alias("total"), "n")


@query("stream_sessions", f"WITH {WATER}, g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER o IS NULL OR ts - lag(ts) OVER o >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), a AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS z, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS begins, strftime(z, '%Y-%m-%d %H:%M:%S') AS ends, n FROM a, m WHERE z <= top - INTERVAL 1 MINUTE")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a pause of six hours."""
    df = streamed(spark, sf_dir, lambda read: Z.sessions(read(), "user_id", "ts", "6 hours", "1 minute"))
    return df.select("user_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("begins", "ends")), "n")


@query("stream_first", "SELECT DISTINCT props FROM events WHERE props IS NOT NULL")
def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id once within 62 days."""
    return streamed(spark, sf_dir, lambda read: Z.first_of_id(read().where(F.col("props").isNotNull()), "props", "ts")).select("props")


@query("stream_outcomes", """WITH f AS (SELECT event_id, user_id % 7 AS k, date_trunc('hour', ts) + INTERVAL 3 HOUR AS z FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id % 7 AS k, date_trunc('hour', ts) + INTERVAL 1 HOUR AS z, value AS close FROM events WHERE event_type = 'signup') SELECT event_id, close AS actual FROM f JOIN b USING (k, z)""")
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of one stream with the bars of another that end at their targets."""

    def made(read: Callable[[], DataFrame]) -> DataFrame:
        hour = lambda n: (F.date_trunc("hour", "ts") + F.expr(f"INTERVAL {n} HOURS"))
        said = read().where("event_type = 'purchase'").select("event_id", (F.col("user_id") % 7).alias("k"), hour(3).alias("target"))
        bars = read().where("event_type = 'signup'").select((F.col("user_id") % 7).alias("k"), hour(1).alias("bar_end"), F.col("value").alias("close"))
        return Z.outcomes(said, bars, "k", "target", "bar_end", "3 hours")

    return streamed(spark, sf_dir, made).select("event_id", "actual")
