"""Problems 1, 2, 3 and 5 on small tables: brute force, nulls, ties, repeats, empty tables, clashing columns."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import implausible as I, known_at as K, regular_grid as G, rolling_totals as R
from quillon.operators.batches import bounds, whole_groups

PRICES = "line_id long, root string, pair string, tf string, bar_time timestamp_ntz, open double, high double, low double, close double, spread double, fetched_at timestamp_ntz, block string, own string, at string, day string, state string"
RATES = "rate_id long, root string, cur string, sid string, freq string, obs_date date, value double, fetched_at timestamp_ntz, seen string, period string, state string"
T0 = dt.datetime(2024, 1, 1)
FRAMES = [("15m", 15, [1, 4, 16]), ("1h", 60, [1, 4, 24]), ("1d", 0, [1, 5, 10, 20])]


def frames(spark):
    return spark.createDataFrame(FRAMES, "tf string, minutes int, horizons array<int>")


def price(i, at, close=1.1, root="r", pair="EURUSD", tf="1h", o=None, h=None, l=None, stored=None):
    o, h, l = (close if x is None else x for x in (o, h, l))
    return (i, root, pair, tf, at, o, h, l, close, None, stored or at, "x", "x", "x", "x", "x")


def walk(n, seed=1, tf="1h", start=1, root="r", pair="EURUSD", level=1.1, size=0.001):
    rng, out, c = np.random.default_rng(seed), [], level
    step = {"1h": dt.timedelta(hours=1), "15m": dt.timedelta(minutes=15), "1d": dt.timedelta(days=1)}[tf]
    for k in range(n):
        o, c = c, c * math.exp(size * rng.standard_normal())
        out.append(price(start + k, T0 + k * step, c, root, pair, tf, o, max(o, c) * (1 + size * rng.random()), min(o, c) * (1 - size * rng.random())))
    return out


def table(spark, rows, schema=PRICES):
    return spark.createDataFrame(rows, schema)


# --- problem 1


def brute_thin(rows):
    series = {}
    for r in rows:
        if r[8] is not None and r[4] is not None:
            series.setdefault((r[1], r[2].upper().replace("/", "").replace("_", ""), r[3]), set()).add(r[4])
    out = set()
    for key, times in series.items():
        days = [t.date() for t in times]
        for k in range((max(days) - min(days)).days + 1):
            day = min(days) + dt.timedelta(days=k)
            c7, c30 = (sum(0 <= (day - d).days < n for d in days) for n in (7, 30))
            if k >= 29 and 60 * c7 < 7 * c30:
                out.add((*key, day.isoformat()))
    return out


def test_thin_days_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        at = T0 + dt.timedelta(hours=rng.randrange(24 * 80))
        rows.append(price(i, at, rng.choice([1.0, 1.1, None]), rng.choice(["a", "b"]), rng.choice(["EURUSD", "eur/USD", "EUR_USD"]), rng.choice(["1h", "1d"])))
    rows += rows[:50] + [price(9999, None)]
    got = {tuple(r) for r in R.thin_days(table(spark, rows)).collect()}
    assert got == brute_thin(rows) and got


def test_rolling_totals_fill_days_without_activity(spark):
    daily = spark.createDataFrame([("a", 10, 5, 1.0), ("a", 13, 7, None), (None, 4, 1, 2.0), ("a", None, 9, 9.0)], "k string, day int, n int, x double")
    got = {(r.k, r.day): (r.n_2, r.n_7, r.x_7) for r in R.rolling_totals(daily, ["k"], ["n", "x"], [2, 7]).collect()}
    assert got == {("a", 10): (5, 5, 1.0), ("a", 11): (5, 5, 1.0), ("a", 12): (0, 5, 1.0), ("a", 13): (7, 12, 1.0), (None, 4): (1, 1, 2.0)}


def test_empty_tables(spark):
    empty, no_rates = table(spark, []), table(spark, [], RATES)
    quotes = spark.createDataFrame([], "root string, pair string, tf string, quote_time timestamp_ntz, price double")
    assert R.thin_days(empty).count() == 0
    assert R.trailing_bars(empty, frames(spark)).count() == 0
    assert I.judged(empty, frames(spark)).count() == 0
    assert K.rates_at_bars(empty, no_rates).count() == 0
    assert G.quote_grid(quotes, frames(spark)).count() == 0


# --- problem 2


def found(spark, rows):
    return {r.line_id: r.state for r in I.judged(table(spark, rows), frames(spark)).collect()}


def test_hard_bounds_and_nulls(spark):
    rows = walk(200)
    bad = {10: dict(close=0.0), 20: dict(l=-1.0), 30: dict(h=0.5), 40: dict(o=9.9)}
    rows = [price(r[0], r[4], **({"close": r[8], "o": r[5], "h": r[6], "l": r[7]} | bad[r[0]])) if r[0] in bad else r for r in rows]
    rows += [price(900, None, 0.0), price(901, None, 1.1), (902, "r", "EURUSD", "1h", T0 + dt.timedelta(hours=50), None, None, None, None, None, T0, "x", "x", "x", "x", "x")]
    got = found(spark, rows)
    assert got == {10: I.IMPOSSIBLE, 20: I.IMPOSSIBLE, 30: I.IMPOSSIBLE, 40: I.IMPOSSIBLE, 900: I.IMPOSSIBLE}


def test_spikes_but_not_lasting_moves_nor_lively_series(spark):
    rows = walk(400) + walk(400, 2, start=1001, root="lively", size=0.02)
    step = lambda r, f: price(r[0], r[4], r[8] * f, r[1], r[2], r[3], r[5] * f, r[6] * f, r[7] * f)
    rows = [step(r, 1.2) if r[0] in (100, 101, 250) else r for r in rows]
    rows = [step(r, 1.3) if 320 <= r[0] <= 400 else r for r in rows]  # lasts
    rows = [(*r[:6], r[6] * 10, *r[7:]) if r[0] == 50 else r for r in rows]  # one price of a bar
    assert found(spark, rows) == {50: I.SPIKE, 100: I.SPIKE, 101: I.SPIKE, 250: I.SPIKE}


def test_frozen_run_without_its_first_bar_and_quiet_repeats(spark):
    rows = walk(300)
    at = {r[0]: r for r in rows}
    freeze = lambda i, j: price(i, at[i][4], at[j][8], o=at[j][8], h=at[j][8], l=at[j][8])
    rows = [freeze(r[0], 99) if 100 <= r[0] < 112 else freeze(r[0], 199) if r[0] in (200, 201, 202) else r for r in rows]
    assert found(spark, rows) == {i: I.STUCK for i in range(101, 112)}


def test_repeated_rows_are_judged_each_by_their_own_values(spark):
    rows = walk(200)
    r = rows[99]
    spiked = price(500, r[4], r[8] * 1.3, o=r[5] * 1.3, h=r[6] * 1.3, l=r[7] * 1.3, stored=T0)
    again = [(*([600 + k]), *r[1:]) for k in range(5)]
    assert found(spark, rows + [spiked, (501, *spiked[1:])] + again) == {500: I.SPIKE, 501: I.SPIKE}


def test_blocks_give_what_whole_series_give(spark):
    rows = [r if r[0] % 97 else price(r[0], r[4], r[8] * 1.2, o=r[5] * 1.2, h=r[6] * 1.2, l=r[7] * 1.2) for r in walk(1500, 5)]
    states = lambda **kw: {(r.at, r.state) for r in I.bar_states(table(spark, rows), frames(spark), **kw).collect() if r.state}
    assert states() == states(block_bars=256, halo_bars=128) and states()


def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(0)
    emit, moves = rng.random((30, 4)), I.transitions(I.Emissions(), np.array([1e-3, 4e-3, 2e-4]))
    group = np.repeat([0, 1, 2], [12, 1, 17])
    got = I.forward_backward(emit, group, moves)
    start = np.array([0.997, 1e-3, 1e-3, 1e-3])
    for move, a, n in zip(moves, *bounds(group)):
        assert np.allclose(move.sum(axis=1), 1, atol=1e-4)
        e = emit[a : a + n]
        for t in range(n):
            f = start.copy()
            for k in range(t):
                f = (f * e[k]) @ move
            b = np.ones(4)
            for k in range(n - 1, t, -1):
                b = move @ (e[k] * b)
            assert np.allclose(got[a + t], f * b / (f * b).sum())


def test_neighbours_decide_about_a_reading_in_between(spark):
    """The same distance is a spike beside a spike and none by itself: no threshold on the distance gives these rows."""
    rows = walk(600, 8)
    unit = float(np.median(np.abs(np.diff([math.log(r[8]) for r in rows]))))
    lift = lambda r, k: price(r[0], r[4], *[r[8] * math.exp(k * unit)], r[1], r[2], r[3], *(x * math.exp(k * unit) for x in r[5:8]))
    far, near = {200: 300, 201: 18, 400: 300}, {300: 18}
    moved = [lift(r, (far | near)[r[0]]) if r[0] in far | near else r for r in rows]
    got = {r.line_id: (r.state, r.distance) for r in I.judged(table(spark, moved), frames(spark)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: I.SPIKE for k in far}
    alone = I.bar_states(table(spark, moved), frames(spark)).where(f"at = {int((moved[299][4] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)}").first()
    assert alone.state == I.NORMAL and alone.distance > 0.8 * got[201][1]


def test_each_source_has_its_own_estimates():
    e, rng = I.Emissions(), np.random.default_rng(4)
    hist = lambda x: np.bincount(I.cells(x), minlength=I.CELLS)
    moves = np.vstack([hist(np.abs(rng.standard_normal(20_000)) * s) for s in (1e-4, 1e-2)])
    far = np.vstack([hist(rng.exponential(3.0 * 0.67e-4, 20_000)), hist(np.r_[rng.exponential(2.0 * 0.67e-2, 20_000), np.full(100, 5.0)])])
    unit, scale, share = I.estimate(moves, far, np.zeros(2, dtype=int), e)
    assert np.allclose(unit, [0.67e-4, 0.67e-2], rtol=0.05)
    assert 2.7 < scale[0] <= 3.0 and 2.0 <= scale[1] < 2.4 and share[1] > 0.003 > share[0]
    assert np.isnan(I.estimate(moves * 0, far * 0, np.zeros(2, dtype=int), e)[0]).all()


def test_sources_without_a_name_or_a_move(spark):
    rows = walk(200)
    nameless = [(r[0] + 1000, None, *r[2:]) for r in rows]
    still = [price(3000 + k, T0 + dt.timedelta(hours=k), 1.0, root="still") for k in range(3)] + [price(4000, T0, 2.0, root="one")]
    spiked = [price(r[0], r[4], r[8] * 1.3, r[1], o=r[5] * 1.3, h=r[6] * 1.3, l=r[7] * 1.3) if r[0] in (100, 1100) else r for r in rows + nameless + still]
    got = found(spark, spiked)
    assert got[100] == I.SPIKE and got[1100] == I.SPIKE and 4000 not in got


# --- problem 3


def test_rates_known_at_the_bars_end(spark):
    rng = random.Random(8)
    bars = [price(i, T0 + dt.timedelta(days=rng.randrange(200)), rng.choice([1.0, None]), rng.choice("ab"), rng.choice(["EURUSD", "usd/JPY"]), rng.choice(["1d", "1d", "1h"])) for i in range(200)]
    rates = []
    for i in range(400):
        obs = (T0 + dt.timedelta(days=rng.randrange(-60, 200))).date()
        stored = rng.choice([None, dt.datetime.combine(obs, dt.time()) + dt.timedelta(hours=rng.randrange(-24 * 20, 24 * 40))])
        rates.append((i, rng.choice(["a", "b", None]), rng.choice(["EUR", "USD", "JPY"]), "s", "d", rng.choice([obs, obs, None]), rng.choice([1.0, 2.0, None]), stored, "x", "x", "x"))
    rates += [(1000 + r[0], *r[1:]) for r in rates[:100]]
    want = {}
    for b in bars:
        if b[3] != "1d":
            continue
        code = b[2].upper().replace("/", "")
        for cur in (code[:3], code[3:]):
            ok = [r for r in rates if r[1] == b[1] and r[2] == cur and r[6] is not None and r[5] is not None and r[7] is not None and r[5] <= b[4].date() and r[7] < b[4] + dt.timedelta(days=1)]
            if ok:
                want[b[0], cur] = max(ok, key=lambda r: (r[5], r[7], r[0]))[0]
    got = {(r.line_id, r.cur): r.rate_id for r in K.rates_at_bars(table(spark, bars), table(spark, rates, RATES)).collect()}
    assert got == want and want


# --- problem 5


def test_grid_has_every_slot_once_and_marks_the_empty_ones(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        at = rng.choice([T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 30), seconds=rng.random() * 59), None])
        rows.append((rng.choice("ab"), rng.choice(["EURUSD", "EUR/usd"]), rng.choice(["15m", "1h"]), at, rng.choice([1.1, 1.2, None])))
    rows += rows[:20] + [("c", "EURUSD", "1h", T0, 1.0), ("a", "EURUSD", "1h", T0 + dt.timedelta(days=400), 1.0)]
    slots = {}
    for root, pair, tf, at, p in rows:
        if at is not None and p is not None:
            w = {"15m": 900, "1h": 3600}[tf]
            slots.setdefault((root, "EURUSD", tf, w), set()).add(int((at - dt.datetime(1970, 1, 1)).total_seconds() // w))
    want = {(*k[:3], s * k[3], s not in v) for k, v in slots.items() for s in range(min(v), max(v) + 1)}
    quotes = spark.createDataFrame(rows, "root string, pair string, tf string, quote_time timestamp_ntz, price double")
    got = G.quote_grid(quotes, frames(spark)).collect()
    assert len(got) == len(want) and {(r.root, r.pair, r.tf, r.slot, r.missing) for r in got} == want
    assert all(math.isfinite(r.value) and r.sd >= 0 and 0.9 < r.value < 1.4 for r in got)


def test_noise_of_the_grid_is_that_of_the_whole_series(spark):
    rng, slot = np.random.default_rng(8), 60_000_000
    at = np.sort(rng.choice(4096 * 4, 900, replace=False)) * (slot // 4) + 1
    value = np.cumsum(rng.standard_normal(900) * np.where(np.arange(900) < 450, 0.01, 1.0))
    df = spark.createDataFrame([("r", "EURUSD", "1m", int(t), float(v), slot) for t, v in zip(at, value)], "root string, pair string, tf string, at long, value double, slot_us long")
    cut, whole = ({r.slot: r for r in G.regular_grid(df, F.col("slot_us"), block_slots=b, halo_slots=h).collect()} for b, h in ((256, 96), (10_000, 96)))
    assert cut.keys() == whole.keys() and all(abs(cut[k].sd / whole[k].sd - 1) < 0.02 for k in cut)
    unit = G.own_units(np.diff(at, prepend=at[0]) / slot, value, np.array([0]), np.array([900]))[0]
    assert all(abs(r.unit / unit - 1) < 1e-9 for r in G.with_units(df).collect())
    assert G.with_units(df.limit(1)).first().unit > 0


def test_smoother_equals_dense_algebra():
    rng = np.random.default_rng(2)
    at, value = np.sort(rng.random(12) * 20), rng.standard_normal(12)
    p = G.Trend()
    got = G.smooth(at, value, np.zeros(12, dtype=int), p)
    q = got["unit"][0]
    # all states at once: prior of the first, the model's steps and the readings as one least-squares problem
    rows, rhs = [], []
    white = lambda cov, a, b: (np.linalg.solve(np.linalg.cholesky(cov), a), np.linalg.solve(np.linalg.cholesky(cov), b))
    a = np.zeros((2, 24)); a[:, :2] = np.eye(2)  # noqa: E702
    for m, r in [white(np.diag([p.start * q, q]), a, np.array([value[0], 0.0]))]:
        rows.append(m), rhs.append(r)
    for k in range(1, 12):
        d = at[k] - at[k - 1]
        s = p.slope * q
        a = np.zeros((2, 24)); a[:, 2 * k : 2 * k + 2] = np.eye(2); a[:, 2 * k - 2 : 2 * k] = -np.array([[1, d], [0, 1]])  # noqa: E702
        m, r = white(np.array([[q * d + s * d**3 / 3, s * d**2 / 2], [s * d**2 / 2, s * d]]), a, np.zeros(2))
        rows.append(m), rhs.append(r)
    for k in range(12):
        a = np.zeros((1, 24)); a[0, 2 * k] = 1 / math.sqrt(p.reading * q)  # noqa: E702
        rows.append(a), rhs.append([value[k] / math.sqrt(p.reading * q)])
    x = np.linalg.lstsq(np.vstack(rows), np.concatenate(rhs), rcond=None)[0]
    assert np.allclose(got["level"], x[0::2], atol=1e-6) and np.allclose(got["slope"], x[1::2], atol=1e-6)


# --- groups out of batches


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_groups_are_never_cut(size):
    key = pa.array([None, None, "a", "a", "a", "b", "c", "c"])
    t = pa.table({"k": key, "v": pa.array(range(8))})
    seen = [(g.tolist(), x.column("v").to_pylist()) for x, g in whole_groups(iter(t.to_batches(max_chunksize=size)), ["k"], rows=2)]
    flat = [v for _, vs in seen for v in vs]
    assert flat == list(range(8))
    homes = {}
    for n, (_, vs) in enumerate(seen):
        for v in vs:
            homes.setdefault(key[v].as_py(), set()).add(n)
    assert all(len(h) == 1 for h in homes.values())
