"""SQL fragments and output forms that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.operators.bars import latest_bars
from quillon.sources.tables import SERIES, table

PAIR = "upper(replace(replace(pair, '/', ''), '_', ''))"
BARS = f"""versions AS (SELECT root, {PAIR} AS pair, tf, bar_time, coalesce(open, close) AS o, coalesce(high, close) AS h, coalesce(low, close) AS l, close AS c,
  row_number() OVER (PARTITION BY root, {PAIR}, tf, bar_time ORDER BY coalesce(fetched_at, TIMESTAMP '1970-01-01') DESC, line_id DESC) AS k
  FROM prices WHERE close IS NOT NULL AND bar_time IS NOT NULL AND least(open, high, low, close) > 0),
bars AS (SELECT root, pair, tf, bar_time, o AS open, greatest(o, h, l, c) AS high, least(o, h, l, c) AS low, c AS close FROM versions WHERE k = 1)"""
W = "PARTITION BY root, pair, tf ORDER BY bar_time"
KEY = "root, pair, tf, strftime(bar_time, '%Y-%m-%d %H:%M:%S') AS bar_time"


class Registry:
    """Named queries with their SQL."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def put(query):
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return put


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_bars(table(spark, sf_dir, "prices"))


def stamp(column: str = "bar_time") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def shown(df: DataFrame, columns: list[str], digits: int | dict[str, int] = 6) -> DataFrame:
    """Series key, bar time as text and the columns, doubles rounded.

    Means of decimal prices get digits beyond their last one, so that no value lies between two roundings.
    """
    kinds = dict(df.dtypes)
    places = lambda c: digits.get(c, 6) if isinstance(digits, dict) else digits
    return df.select(*SERIES, stamp(), *((F.round(c, places(c)) if kinds[c] == "double" else F.col(c)).alias(c) for c in columns))


def rounded(sql_columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) AS {c}" for c, e in sql_columns.items())
