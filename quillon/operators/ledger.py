"""Append-only records: hash chains, their verification, commits and rules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillon.operators.batches import in_order, whole_groups

GENESIS = "0" * 64


def canonical(record: dict) -> bytes:
    """A record as bytes that don't depend on the order of its keys; no NaN."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def chained(records: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """key, seq, payload, prev and hash: sha-256 of the hash before and the payload, in order, per key.

    A chain is sequential by definition; chains run beside one another, each in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, [key]):
            seq, prev, out = np.empty(len(group), dtype=np.int64), [], []
            last, n, at = GENESIS, 0, -1
            for i, (g, text) in enumerate(zip(group.tolist(), table.column("payload").to_pylist())):
                if g != at:
                    last, n, at = GENESIS, 0, g
                n += 1
                seq[i] = n
                prev.append(last)
                last = hashlib.sha256((last + text).encode()).hexdigest()
                out.append(last)
            columns = {key: table.column(key), "seq": pa.array(seq), "payload": table.column("payload"), "prev": pa.array(prev), "hash": pa.array(out)}
            yield from pa.table(columns).to_batches()

    rows = in_order(records.select(key, F.col(payload).alias("payload"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))), [key], *(f"_o{i}" for i in range(len(order))))
    return rows.mapInArrow(run, f"{key} string, seq bigint, payload string, prev string, hash string")


def broken(chain: DataFrame, key: str) -> DataFrame:
    """Records whose number, link or hash is wrong; checked by windows, all records at once."""
    w = Window.partitionBy(key).orderBy("seq")
    before = F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))
    checks = {"seq": F.row_number().over(w) != F.col("seq"), "prev": before != F.col("prev"), "hash": F.sha2(F.concat("prev", "payload"), 256) != F.col("hash")}
    marked = chain.withColumns({f"_{k}": v for k, v in checks.items()})
    kinds = F.array_compact(F.array(*(F.when(F.col(f"_{k}"), F.lit(k)) for k in checks)))
    return marked.select(key, "seq", F.explode(kinds).alias("kind"))
