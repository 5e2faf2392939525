"""Structured Streaming forms of the micro-batch cycle: bars, dedupe, sliding pressures, outcomes, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def ticks(spark: SparkSession, folder: str, schema: str, at: str, files_a_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, with ``at`` as an instant in the session's zone."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return read.withColumn(at, F.col(at).cast("timestamp"))


def tumbling_bars(stream: DataFrame, key: str, at: str, price: str, tie: str, length: str, late: str = "3 minutes") -> DataFrame:
    """Bars of each key that are emitted once ``late`` has passed after their end; later ticks are dropped."""
    order = F.struct(at, tie)
    grouped = stream.withWatermark(at, late).groupBy(key, F.window(at, length).alias("w"))
    bars = grouped.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("ticks"))
    return bars.select(key, F.col("w.start").alias("bar_time"), "open", "high", "low", "close", "ticks")


def sliding_sums(stream: DataFrame, key: str, at: str, value: str, length: str, step: str, late: str) -> DataFrame:
    """Sums over overlapping windows, such as 48 hours every 2 hours."""
    w = stream.withWatermark(at, late).groupBy(key, F.window(at, length, step).alias("w")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.end").alias("at"), "total", "n")


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    w = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def first_of_id(stream: DataFrame, ident: str, at: str, memory: str = "62 days") -> DataFrame:
    """Each id once within ``memory``."""
    return stream.withWatermark(at, memory).dropDuplicatesWithinWatermark([ident])


def outcomes(forecasts: DataFrame, bars: DataFrame, key: str, target: str, bar_end: str, late: str = "1 hour") -> DataFrame:
    """Forecasts joined to the bar that ends at their target; state is dropped once that can't come any more."""
    f, b = forecasts.withWatermark(target, late).alias("f"), bars.withWatermark(bar_end, late).alias("b")
    on: Column = (F.col(f"f.{key}") == F.col(f"b.{key}")) & (F.col(f"f.{target}") == F.col(f"b.{bar_end}"))
    return f.join(b, on).select("f.*", F.col("b.close").alias("actual"))


def once_per_batch(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body that is given each non-empty batch; ``write`` must put a batch id's rows in one place."""

    def body(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(batch, batch_id)

    return body


def idempotent_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in its own folder, overwritten when the batch is run again: exactly once after a failure."""
    return once_per_batch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))


def drained(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run all that is there and stop; call again for what came since."""
    writer = stream.writeStream.foreachBatch(idempotent_parquet(path)).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start()
