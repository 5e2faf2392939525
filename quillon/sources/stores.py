"""Append-only tables: only new rows are written, partitioned so that readers skip what they don't need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from quillon.sources.tables import SERIES


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_new_bars(bars: DataFrame, path: str) -> None:
    """Add the bars newer than the last stored one of their series, each once; late bars stay out.

    Partitioned by tf; series and years are spread over the tasks, so a file holds whole years of a few series.
    """
    rest = [c for c in bars.columns if c not in (*SERIES, "bar_time")]
    bars = bars.groupBy(*SERIES, "bar_time").agg(F.max(F.struct(*rest)).alias("v")).select(*SERIES, "bar_time", "v.*")
    held = stored(bars.sparkSession, path)
    if held is not None:
        last = held.groupBy(*SERIES).agg(F.max("bar_time").alias("_last"))
        bars = bars.join(last, SERIES, "left").where(F.col("_last").isNull() | (F.col("bar_time") > F.col("_last"))).drop("_last")
    bars.repartition("tf", "root", "pair", F.year("bar_time")).write.mode("append").partitionBy("tf").parquet(path)


def append_new_items(items: DataFrame, path: str, days: int = 62) -> None:
    """Add items whose id was not stored in the last ``days`` days before them, once each. Partitioned by month.

    Of the stored items only the months that those days reach into are read; a month is written by many tasks.
    """
    once = items.groupBy("id").agg(F.min_by(F.struct(*[c for c in items.columns if c != "id"]), "fetched_at").alias("v")).select("id", "v.*")
    held = stored(items.sparkSession, path)
    if held is not None:
        since = F.col("fetched_at") - F.make_dt_interval(F.lit(days))
        first = once.agg(F.date_format(F.min(since), "yyyy-MM")).first()[0]
        known = held.where(F.col("month") >= (first or "")).groupBy("id").agg(F.max("fetched_at").alias("_at"))
        once = once.join(known, "id", "left").where(F.col("_at").isNull() | (F.col("_at") < since)).drop("_at")
    month = F.date_format("fetched_at", "yyyy-MM")
    once.withColumn("month", month).repartition("month", F.pmod(F.xxhash64("id"), F.lit(64))).write.mode("append").partitionBy("month").parquet(path)


def items_since(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Items stored from ``since`` (yyyy-MM-dd) on; older months are not read."""
    return spark.read.parquet(path).where((F.col("month") >= since[:7]) & (F.col("fetched_at") >= F.lit(since).cast("timestamp_ntz")))
