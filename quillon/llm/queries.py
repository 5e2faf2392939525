"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import byte_bpe, mixing, nearest_time, residue
from quillon.plans.data_problems import PAIR
from quillon.session import durable
from quillon.sources.tables import SMALL, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_time.quotes_at_bars(table(spark, sf_dir, "quotes"), table(spark, sf_dir, "prices"), table(spark, sf_dir, "timeframes")).select("quote_id", "line_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_ids(table(spark, sf_dir, "documents"), ["doc_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.source_sizes(mixing.sized(table(spark, sf_dir, "documents")))
    return mixing.allocation(sizes, table(spark, sf_dir, "mix_targets")).where("short").select("source")


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Budgets and mixture; the sizes are written down once, for they are read three times."""
    targets = table(spark, sf_dir, "mix_targets")
    sizes = durable(mixing.sized(table(spark, sf_dir, "documents")))
    budget = mixing.allocation(mixing.source_sizes(sizes), targets)
    return budget, mixing.mixture(sizes, budget, few_sources=targets.limit(SMALL + 1).count() <= SMALL)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir)[1]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached(*mixed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"), ["doc_id"]).where("residue").select("doc_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents without residue."""
    return residue.residue(table(spark, sf_dir, "documents"), ["doc_id", "source", "n_chars"]).where("NOT residue").select("doc_id", "source", "n_chars")


def p8_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.validation(table(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_clean": p8_clean, "p8_validation": p8_validation}

ORACLE = {
    "p4_found": f"""WITH q AS (SELECT quote_id, root, {PAIR} AS pair, tf, epoch_us(quote_time) AS at FROM quotes WHERE quote_time IS NOT NULL),
b AS (SELECT line_id, root, {PAIR} AS pair, tf, epoch_us(bar_time) AS at FROM prices WHERE close IS NOT NULL),
ranked AS (SELECT quote_id, line_id, row_number() OVER (PARTITION BY quote_id ORDER BY abs(b.at - q.at), b.at, line_id) AS k
  FROM q JOIN timeframes t USING (tf)
  JOIN b ON b.root = q.root AND b.pair = q.pair AND b.tf = q.tf AND b.at BETWEEN q.at - CAST(minutes AS BIGINT) * 60000000 AND q.at + CAST(minutes AS BIGINT) * 60000000)
SELECT quote_id, line_id FROM ranked WHERE k = 1""",
}
