"""Parsers of market, news and rate payloads held as strings or bytes in a column, all in built-in expressions but one."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.operators.bars import repaired
from quillon.operators.text import clean, normal_key

CHART = "struct<chart:struct<result:array<struct<meta:struct<exchangeTimezoneName:string,regularMarketPrice:double>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>>>>>>>>"


def chart_bars(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Bars of chart payloads with columnar arrays: key, at (epoch seconds), zone, open, high, low, close.

    Rows without a close are dropped; missing prices are repaired; of equal instants the last entry stays.
    A payload that can't be read gives nothing.
    """
    r = F.try_element_at(F.from_json(payload, CHART)["chart"]["result"], F.lit(1))
    q = F.try_element_at(F.col("_r.indicators.quote"), F.lit(1))
    parts = F.arrays_zip(F.col("_r.timestamp").alias("at"), *(F.col(f"_q.{c}").alias(c) for c in ("open", "high", "low", "close")))
    rows = payloads.select(key, r.alias("_r")).withColumn("_q", q).select(key, F.col("_r.meta.exchangeTimezoneName").alias("zone"), F.posexplode(parts).alias("_k", "_v"))
    rows = rows.select(key, "zone", "_k", "_v.*").where(F.col("close").isNotNull() & F.col("at").isNotNull())
    last = rows.groupBy(key, "zone", "at").agg(F.max_by(F.struct("open", "high", "low", "close"), "_k").alias("v"))
    return repaired(last.select(key, "zone", "at", "v.*"))


def daily_chart(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Daily bars: the day of each stamp on the exchange's clock, weekdays only, the last of a day."""
    bars = chart_bars(payloads, key, payload)
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.coalesce("zone", F.lit("UTC")), F.timestamp_add("SECOND", F.col("at"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))))
    days = bars.withColumn("day", local).where(F.weekday("day") < 5)
    return days.groupBy(key, "day").agg(F.max_by(F.struct("open", "high", "low", "close"), "at").alias("v")).select(key, "day", "v.*")


def intraday_chart(payloads: DataFrame, key: str, payload: str, cutoff: int, minutes: int) -> DataFrame:
    """Bars on the grid of ``minutes`` that had ended, with three minutes to settle, at ``cutoff`` (epoch seconds)."""
    bars = chart_bars(payloads, key, payload)
    return bars.where((F.col("at") % (60 * minutes) == 0) & (F.col("at") + 60 * minutes + 180 <= cutoff)).drop("zone")


def flat_rates(payloads: DataFrame, payload: str, quote: str) -> DataFrame:
    """Flat daily bars of a payload of rates by date."""
    rates = F.from_json(payload, "struct<rates:map<string,map<string,double>>>")["rates"]
    rows = payloads.select(F.explode(rates).alias("day", "by")).select(F.to_date("day").alias("day"), F.try_element_at("by", F.lit(quote)).alias("close"))
    return repaired(rows.where(F.col("close").isNotNull()).select("day", *(F.lit(None).cast("double").alias(c) for c in ("open", "high", "low")), "close"))


def rate_csv(spark, path: str) -> DataFrame:
    """date,value files of a rate series; values that are no numbers are dropped."""
    return rate_rows(spark.read.csv(path, header=True, schema="date string, value string"))


def rate_rows(raw: DataFrame) -> DataFrame:
    """obs_date and value of written dates and values."""
    return raw.select(F.expr("try_cast(date AS date)").alias("obs_date"), F.expr("try_cast(value AS double)").alias("value")).where(F.col("obs_date").isNotNull() & F.col("value").isNotNull())


def feed_items(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Items of RSS, Atom or RDF feeds: key, title, link, published (as written), publisher ("" where none is named);
    items without a title are dropped."""
    text = F.col(payload)
    item = r"(?s)<(item|entry)\b[^>]*>(.*?)</(?:item|entry)>"
    rows = payloads.select(key, F.explode(F.regexp_extract_all(text, F.lit(item), 2)).alias("_i"))

    def tag(name: str) -> Column:
        inner = F.regexp_extract("_i", rf"(?s)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", 1)
        return clean(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))

    filled = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    href = F.regexp_extract("_i", r"<link\b[^>]*href=\"([^\"]*)\"", 1)
    out = rows.select(key, tag("title").alias("title"), filled(tag("link"), href).alias("link"), filled(tag("pubDate"), tag("published"), tag("updated"), tag("date")).alias("published"), tag("source").alias("publisher"))
    return out.where(F.col("title") != "")


def feed_time(published: Column) -> Column:
    """Instant of a mail-style or ISO date, null where it is neither."""
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(published, r"^[A-Za-z]{3}, ", ""), r" (?:GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(mail, F.try_to_timestamp(published))


def normalised(items: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """Feed items with an id of their normal key; published no later than ``now`` and no more than ``days`` before.

    A title that ends with " - " and its publisher loses that end.
    """
    if "publisher" in items.columns:
        end = F.concat(F.lit(" - "), F.col("publisher"))
        ends = (F.col("publisher") != "") & F.endswith("title", end)
        items = items.withColumn("title", F.when(ends, F.trim(F.substring("title", F.lit(1), F.length("title") - F.length(end)))).otherwise(F.col("title")))
    at = F.least(F.coalesce(feed_time(F.col("published")), now), now)
    kept = items.withColumn("published_at", at).where(F.col("published_at") >= now - F.make_dt_interval(F.lit(days)))
    return kept.withColumn("id", F.substring(F.sha2(normal_key(F.col("title")), 256), 1, 16)).withColumn("title", F.substring("title", 1, 300))


def first_seen(items: DataFrame, by: str = "id", order: tuple[str, ...] = ("published_at", "link")) -> DataFrame:
    """One item per id: the first in the order."""
    rest = [c for c in items.columns if c != by]
    return items.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("v")).select(by, "v.*")


def hourly_records(files: DataFrame, point: float) -> DataFrame:
    """Compressed fixed-width records (time, open, close, low, high as integers, volume) of binary files: path, second, prices.

    ``files`` is the ``binaryFile`` source. Records without volume are dropped. A file that can't be read gives nothing.
    """
    record = np.dtype([("second", ">u4"), ("open", ">u4"), ("close", ">u4"), ("low", ">u4"), ("high", ">u4"), ("volume", ">f4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    raw = lzma.decompress(content) if content else b""
                except lzma.LZMAError:
                    continue
                rows = np.frombuffer(raw[: len(raw) // record.itemsize * record.itemsize], dtype=record)
                rows = rows[rows["volume"] > 0]
                columns = [pa.array([path] * len(rows), pa.string()), pa.array(rows["second"].astype(np.int64))]
                columns += [pa.array(rows[c].astype(np.float64) / point) for c in ("open", "high", "low", "close")]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "second", "open", "high", "low", "close"])

    return files.select("path", "content").mapInArrow(run, "path string, second bigint, open double, high double, low double, close double")


def mid_bars(bid: DataFrame, ask: DataFrame, keys: list[str]) -> DataFrame:
    """Mid prices and spread where both sides have a bar."""
    a = ask.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close")))
    both = bid.join(a, keys)
    mids = {c: (F.col(c) + F.col(f"_{c}")) / 2 for c in ("open", "high", "low", "close")}
    return both.select(*keys, *(v.alias(k) for k, v in mids.items()), (F.col("_close") - F.col("close")).alias("spread"))
