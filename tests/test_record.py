"""Quantiles, as-of blocks, counts, learning, audit, strengths, paths, made markets, command line: plain versions and edges."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import __main__ as cli
from quillon.operators import forecasting as M, joins as J, record as C, season as N, stats as P
from quillon.sources import synthetic

T0 = dt.datetime(2024, 1, 1)


def test_quantiles_by_bins_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.standard_normal(501) * 7] + [("b", 3.0)] * 40 + [("c", 1.0), ("c", 9.0), ("d", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.low, r.mid, r.top) for r in P.quantiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, 2.0).collect() if r.k}
    a = [v for k, v in rows if k == "a"]
    assert got.keys() == {"a", "b", "c"} and np.allclose(got["a"], np.quantile(a, [0.1, 0.5, 1.0])) and got["b"] == (3.0, 3.0, 3.0) and np.allclose(got["c"], (1.8, 5.0, 9.0))
    assert P.quantiles(df.limit(0), ["k"], "v", {"mid": 0.5}, 2.0).count() == 0


def test_weighted_quantile_by_bins_equals_the_ordered_sum(spark):
    rng = random.Random(2)
    rows = [("a", i, round(rng.uniform(0, 9), 1), rng.random()) for i in range(300)] + [("b", 1, 2.0, 1.0), ("b", 2, None, 5.0)]
    got = {r.k: r.value for r in P.weighted_quantile(spark.createDataFrame(rows, "k string, i int, v double, w double"), ["k"], "v", "w", "i", 0.8).collect()}
    a = sorted((v, i, w) for k, i, v, w in rows if k == "a")
    run, total = 0.0, sum(w for *_, w in a)
    for v, _, w in a:
        run += w
        if run >= 0.8 * total - 1e-12:
            break
    assert got == {"a": v, "b": 2.0}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 40])
def test_blocks_of_an_asof_join_change_nothing(spark, strict, tolerance):
    rng = random.Random(3)
    left = [(i, rng.choice("ab"), rng.randrange(-500, 500)) for i in range(200)] + [(900, None, 5), (901, "a", None), (902, "z", 5)]
    right = [(rng.choice("ab"), rng.randrange(-500, 400), rng.choice([None, 1.0, 2.0])) for _ in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "k string, s long, v double")
    one, cut = ({r.i: (r.v, r.as_of) for r in J.asof(a, b, ["k"], "t", "s", ["v"], tolerance, strict, width=w).collect()} for w in (None, 64))
    assert one == cut and len(one) == 203 and one[902] == (None, None)


def test_counts_before_equal_brute_force(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.randrange(300)) for _ in range(400)] + [("a", None)]
    asks = [(i, rng.choice("abc"), rng.randrange(-20, 330)) for i in range(150)] + [(999, "a", None)]
    got = {r.i: r.n for r in J.counted_before(spark.createDataFrame(points, "k string, p long"), spark.createDataFrame(asks, "i int, k string, t long"), "i", "t", 50, 32, ["k"], "p").collect()}
    assert got == {i: sum(k == q and p is not None and t is not None and t - 50 <= p < t for q, p in points) for i, k, t in asks}


def test_interpolation_equals_numpy(spark):
    knots = [("a", 0, 1.0), ("a", 10, 2.0), ("a", 40, -1.0), ("b", 5, 7.0)]
    points = [(i, k, t) for i, (k, t) in enumerate([("a", -5), ("a", 0), ("a", 3), ("a", 10), ("a", 33), ("a", 99), ("b", 1), ("b", 5), ("b", 9), ("c", 1)])]
    for width in (None, 8):
        got = {r.i: r.u for r in J.interpolated(spark.createDataFrame(points, "i int, k string, t long"), spark.createDataFrame(knots, "k string, t0 long, u double"), ["k"], "t", "t0", "u", width).collect()}
        assert got.pop(9) is None and np.allclose([got[i] for i in range(9)], [*np.interp([-5, 0, 3, 10, 33, 99], [0, 10, 40], [1, 2, -1]), 7, 7, 7])


def test_the_first_usable_source_of_each_key(spark):
    s = lambda rows: spark.createDataFrame(rows, "k string, v int")
    got = J.first_usable([s([("a", 1), ("b", 1)]), s([("a", 2), ("a", 3), ("b", 2), ("b", 3)])], ["k"], 2).collect()
    assert {(r.k, r.v, r.source) for r in got} == {("a", 2, 1), ("a", 3, 1), ("b", 2, 1), ("b", 3, 1)}


def test_learning_keeps_priors_and_limits(spark):
    schema = "tf string, m1 double, m2 double, a double, s double, k double, g double, c0 double, c double, x double, d double, w double"
    rng = np.random.default_rng(5)
    rows = [("h", 0.0, float(a), float(a), 1.0, 1.0, 0.0, float(a), 0.0, float(np.sign(a)), 0.0, 1.0) for a in rng.standard_normal(2000)]
    r = C.learned(spark.createDataFrame(rows, schema), ["tf"], ["m1", "m2"], "w").first()
    assert r.w_m2 > 0.9 and abs(r.w_m1 + r.w_m2 - 1) < 1e-6 and 0.9 < r.gain <= 1.0 and r.beta == 0.5 and 0.9 < r.k < 1.1
    few = C.learned(spark.createDataFrame(rows[:1], schema), ["tf"], ["m1", "m2"], "w").first()
    assert abs(few.w_m1 - 0.5) < 0.05 and abs(few.gain) < 0.1


def test_strengths_add_up_to_zero_and_explain_the_moves(spark):
    true = {"USD": 0.4, "JPY": -0.9, "EUR": 0.5}
    rows = [("d", a, b, true[a] - true[b]) for a, b in (("USD", "JPY"), ("EUR", "USD"), ("EUR", "JPY"))] + [("few", "USD", "JPY", 1.0), ("d", "USD", "JPY", None)]
    got = {(r.day, r.cur): r.strength for r in C.strengths(spark.createDataFrame(rows, "day string, base string, quote string, x double"), ["day"]).collect()}
    assert got.keys() == {("d", c) for c in true} and all(abs(got["d", c] - v) < 1e-9 for c, v in true.items())


def test_chances_and_ranges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (2.0, 1.0)], "c double, s double")
    got = df.select(C.chance_up(F.col("c"), F.col("s"), 5).alias("p"), C.chance_up(F.col("c"), F.col("s"), None).alias("n"), C.ranges(F.lit(100.0), F.col("c"), F.col("s"), 5)["hi80"].alias("h")).collect()
    assert abs(got[0].p - 0.5) < 1e-12 and got[1].p == 0.5 and 0.9 < got[2].p < got[2].n < 1 and abs(got[0].h - 100 * np.exp(1.2816e-4)) < 1e-9


def test_slot_windows_equal_counting(spark):
    rng = random.Random(6)
    rows = [("r", "p", T0 + dt.timedelta(hours=6 * i), i % 3, rng.gauss(0, 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "root string, pair string, bar_time timestamp_ntz, slot long, x double")
    got = {(r.day, r.slot): (r.n, r.mean) for r in N.window_stats(df, ["root", "pair"], "slot", 10).collect()}
    for day in {r[2].date() for r in rows}:
        held = [r for r in rows if r[2].date() < day][-10:]
        for slot in range(3):
            own = [r[4] for r in held if r[3] == slot]
            assert (day, slot) in got if own else (day, slot) not in got
            assert not own or (got[day, slot][0] == len(own) and abs(got[day, slot][1] - sum(own) / len(own)) < 1e-9)


def test_backtests_see_no_later_bar(spark):
    rng = np.random.default_rng(7)
    rows = [("r", "p", "1d", T0 + dt.timedelta(days=i), float(c)) for i, c in enumerate(np.exp(np.cumsum(rng.standard_normal(300) * 0.01)))]
    schema = "root string, pair string, tf string, bar_time timestamp_ntz, close double"
    run = lambda r: {(x.origin, x.model, x.h): x.bp for x in M.backtests(spark.createDataFrame(r, schema), [1, 5], 40, 3, 120).collect()}
    whole = run(rows)
    cut = run([(*r[:4], r[4] * (5.0 if r[3] > T0 + dt.timedelta(days=250) else 1.0)) for r in rows])
    early = {k for k in whole if k[0] <= T0 + dt.timedelta(days=250)}
    assert early and all(abs(whole[k] - cut[k]) < 1e-6 for k in early) and len({k[0] for k in whole}) == 40


def test_a_longer_made_market_begins_with_the_shorter_one(spark):
    pairs = spark.createDataFrame([("EURUSD", 1.1), ("USDJPY", 150.0)], "pair string, level double")
    short, long = ({(r.pair, r.k): (r.open, r.high, r.low, r.close) for r in synthetic.hourly_bars(pairs, n, 3, block=b).collect()} for n, b in ((40, 16), (100, 64)))
    assert all(np.allclose(v, long[k]) for k, v in short.items()) and all(lo <= min(o, c) and max(o, c) <= h for o, h, lo, c in long.values())
    assert synthetic.hourly_bars(pairs, 0, 3).count() == 0


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "p1_found" in capsys.readouterr().out
    assert cli.main(["sql", "p1_found"]) == 0 and "SELECT" in capsys.readouterr().out
    assert cli.main(["sql", "nothing"]) == 2


def test_candles_are_whole_and_end_where_they_should(spark):
    from quillon.operators import candles as K

    rng, rows, c = np.random.default_rng(9), [], 1.0
    days = [T0 + dt.timedelta(days=i) for i in range(600) if (T0 + dt.timedelta(days=i)).weekday() < 5]
    for t in days:
        o, c = c, c * float(np.exp(0.01 * rng.standard_normal()))
        rows.append(("r", "p", "1d", t, o, max(o, c) * 1.002, min(o, c) * 0.998, c, float(np.log(1.5))))
    rows += [("short", *r[1:]) for r in rows[:100]] + [("flat", "p", "1d", t, 1.0, 1.0, 1.0, 1.0, 0.0) for t in days]
    df = spark.createDataFrame(rows, "root string, pair string, tf string, bar_time timestamp_ntz, open double, high double, low double, close double, goal double")
    free = {r.k: r for r in K.forecast_candles(df, 10).collect()}
    aimed = {r.k: r for r in K.forecast_candles(df, 10, target="goal").collect()}
    assert sorted(free) == sorted(aimed) == list(range(1, 11)) and {r.root for r in free.values()} == {"r"}
    for path in (free, aimed):
        assert all(r.low <= min(r.open, r.close) and max(r.open, r.close) <= r.high for r in path.values())
        assert abs(path[1].open - c) < 1e-12 and all(abs(path[k].open - path[k - 1].close) < 1e-12 for k in range(2, 11))
    assert abs(aimed[10].close - 1.5) < 1e-9
    after = np.random.default_rng(1).standard_normal((12, 4))
    apart = ((after[:, None] - after[None]) ** 2).sum(axis=(1, 2))
    assert apart.argmin() == ((after - after.mean(axis=0)) ** 2).sum(axis=1).argmin()
