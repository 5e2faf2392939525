"""Composite operators against plain versions."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import studies as S
from quillon.plans import studying as P


def test_leaders_equal_the_greedy_walk(spark):
    rng = random.Random(9)
    items = [(i, rng.randrange(100)) for i in range(60)]
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)})
    near = {i: set() for i, _ in items}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    want, order = {}, sorted(items, key=lambda x: (x[1], x[0]))
    for i, _ in order:
        lead = [j for j, _ in order if j in near[i] and want.get(j) == j]
        want[i] = lead[0] if lead else i
    got = S.leaders(spark.createDataFrame(pairs, "a int, b int"), spark.createDataFrame(items, "id int, at int"), "id", "at")
    assert {r.id: r.story for r in got.collect()} == want


def test_least_squares_and_what_cannot_be_solved(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 2))
    rows = [("a", float(u), float(v), float(2 + 3 * u - v)) for u, v in x] + [("b", 1.0, 2.0, 3.0), ("a", None, 1.0, 1.0)]
    got = {r.k: r for r in S.ols(spark.createDataFrame(rows, "k string, u double, v double, y double"), ["k"], ["u", "v"], "y").collect()}
    assert got["a"].n == 50 and np.allclose([got["a"].b_const, got["a"].b_u, got["a"].b_v], [2, 3, -1])
    assert got["b"].b_u is None


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(1, i, float(i % 10)) for i in range(500)], "k int, i int, v double")
    r = S.bootstrap_mean(df, ["k"], "v", F.col("i")).first()
    assert abs(r.mean - 4.5) < 1e-9 and 4.1 < r.low < 4.5 < r.high < 4.9
    assert abs((r.high - r.low) / 2 - 1.96 * 2.87 / 500**0.5) < 0.08


def test_replayed_scale_uses_the_past_only(spark):
    rows = [("a", i, 1.0 if i < 50 else 5.0) for i in range(100)]
    run = lambda rs: [r.scale for r in S.replay_scale(spark.createDataFrame(rs, "k string, i int, s double"), ["k"], "i", "s").orderBy("i").collect()]
    whole = run(rows)
    assert whole[:60] == run(rows[:60]) and whole[0] == 1.0 and whole[99] > whole[50]


def test_stories_judge_each_copy_at_its_time(spark, tmp_path):
    rng, said = random.Random(4), ["Dollar rose against the yen today", "Dollar rose against the yen again", "Dollar rose against the yen, today", "Pound eased after the minutes", "Pound eased after the minute"]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(said), start + dt.timedelta(days=rng.randrange(8), minutes=rng.randrange(1440))) for i in range(60)]
    rows += [(100, said[0], dt.datetime(2024, 6, 1)), (101, said[1], dt.datetime(2024, 6, 1, 1)), (102, said[0], dt.datetime(2024, 6, 1)), (103, said[0], dt.datetime(2024, 9, 1)), (104, said[0], None)]
    spark.createDataFrame(rows, "doc_id long, text string, published_at timestamp_ntz").write.parquet(str(tmp_path / "documents.parquet"))
    parts = lambda text: (lambda k: {k[i : i + 3] for i in range(len(k) - 2)})("".join(c for c in text.lower() if c.isalnum()))
    want, lead = {}, []
    for i, text, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        s = parts(text)
        near = [j for j, other, when in lead if at - when <= dt.timedelta(hours=12) and len(s & other) / len(s | other) >= 0.6]
        want[i] = near[0] if near else i
        if not near:
            lead.append((i, s, at))
    assert {r.doc_id: r.story for r in P.stories(spark, str(tmp_path)).collect()} == want
    assert want[101] == want[100] == want[102] == 100 and want[103] == 103
