"""Readers of the project's tables and the column forms that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

SERIES = ["root", "pair", "tf"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_pair(pair: Column) -> Column:
    """The code of a pair without the spellings' slashes, underscores and lower case."""
    return F.upper(F.translate(pair, "/_", ""))


def of_series(df: DataFrame, *more: str) -> DataFrame:
    """The series key with the plain pair code, and the named columns; nothing else is read."""
    return df.select("root", plain_pair(F.col("pair")).alias("pair"), "tf", *more)


SMALL = 10_000


def few(df: DataFrame, most: int = SMALL) -> list[Row]:
    """The distinct settings that shape a plan, on the driver: they become columns, of which there can't be more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of settings has more than {most} rows")
    return rows


def lengths(timeframes: DataFrame) -> DataFrame:
    """tf and ``length``, its bars' length in microseconds; 0 for daily bars. One row a timeframe."""
    longest = F.max("minutes").cast("long") * F.lit(60_000_000)
    return small(timeframes.where(F.col("tf").isNotNull()).groupBy("tf").agg(F.coalesce(longest, F.lit(0).cast("long")).alias("length")))


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Broadcast a table whose size was looked at: beyond ``most`` rows it stays an ordinary side of the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
