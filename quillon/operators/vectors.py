"""Nearest neighbours of a stated query set against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def nearest(rows: DataFrame, queries: DataFrame, ident: str, vector: str, k: int = 10, block: int = 16_384, shard: int = 20_000, step: int = 512) -> DataFrame:
    """query, neighbour, distance (squared) and place of the ``k`` nearest other rows of each query.

    Queries are cut into blocks of about ``block``, rows into shards of about ``shard``; each (block, shard) keeps k per
    query by matrix products of ``step`` queries, and a window over those few picks the k of all shards. A row is sent
    once a block, a query once a shard; large blocks keep the copies of the rows few (one up to 16,384 queries), and a
    task's memory doesn't grow with the tables. Null vectors take no part. This is the exact way; it does all the work
    that all queries against all rows are.
    """
    rows, queries = rows.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    blocks, shards = max(1, -(-queries.count() // block)), max(1, -(-rows.count() // shard))
    lot = F.pmod(F.xxhash64(ident), F.lit(1 << 30))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select(F.col(ident).alias("query"), F.col(vector).alias("v"), F.pmod(lot, F.lit(blocks)).alias("block"), each(shards).alias("shard"))
    r = rows.select(F.col(ident).alias("row"), F.col(vector).alias("v"), F.pmod(lot, F.lit(shards)).alias("shard"), each(blocks).alias("block"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        x, y = np.stack(a["v"].to_numpy()).astype(np.float64), np.stack(b["v"].to_numpy()).astype(np.float64)
        asked, held, norm = a["query"].to_numpy(), b["row"].to_numpy(), (y * y).sum(axis=1)
        m, parts = min(k, len(y)), []
        for i in range(0, len(x), step):
            own = x[i : i + step]
            d = np.maximum((own * own).sum(axis=1)[:, None] + norm[None, :] - 2 * own @ y.T, 0.0)
            d[asked[i : i + step][:, None] == held[None, :]] = np.inf
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            parts.append(pd.DataFrame({"query": np.repeat(asked[i : i + step], m), "neighbour": held[near.ravel()], "distance": np.take_along_axis(d, near, axis=1).ravel()}))
        out = pd.concat(parts, ignore_index=True)
        return out[np.isfinite(out["distance"])]

    found = q.groupBy("block", "shard").cogroup(r.groupBy("block", "shard")).applyInPandas(search, "query bigint, neighbour bigint, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)
