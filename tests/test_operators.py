"""Recursions, forecasts, scores, ledger, joins, feeds, stores and streams against plain versions."""

import datetime as dt
import json
import lzma
import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import bars as B, forecasting as M, joins as J, ledger as L, recursive as R, signals as S, stats as P, text as X, trades as T, vectors
from quillon.sources import feeds, stores
from quillon.streaming import pipeline as Z

BARS = "root string, pair string, tf string, bar_time timestamp_ntz, open double, high double, low double, close double"
T0 = dt.datetime(2024, 1, 1)


def walk(n, root="r", seed=0):
    rng, c, out = np.random.default_rng(seed), 100.0, []
    for k in range(n):
        o, c = c, c * math.exp(0.01 * rng.standard_normal())
        out.append((root, "EURUSD", "1d", T0 + dt.timedelta(days=k), o, max(o, c) * 1.002, min(o, c) * 0.998, c))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(700) + walk(40, "s", 1) + walk(1, "one", 2), BARS)


def series(df, root, *columns):
    return df.where(F.col("root") == root).orderBy("bar_time").select(*columns).toPandas()


def test_exponential_over_blocks_equals_the_recursion(bars):
    got = series(R.exponential(bars, {"e": ("close", 0.1, 5)}), "r", "close", "e")
    want = got.close.ewm(alpha=0.1, adjust=False, min_periods=5).mean()
    assert np.allclose(got.e, want, equal_nan=True, rtol=1e-12)


def test_exponential_passes_over_unknown_values(bars):
    df = bars.withColumn("x", F.when(F.dayofmonth("bar_time") % 3 != 0, F.col("close")))
    got = series(R.exponential(df, {"e": ("x", 0.2, 1)}), "r", "x", "e")
    want = got.x.ewm(alpha=0.2, adjust=False, ignore_na=True).mean().where(got.x.notna())
    assert np.allclose(got.e, want, equal_nan=True, rtol=1e-12)


def test_one_pass_recursions_equal_the_block_forms(bars):
    one = series(R.recursions(bars), "r", "macd", "macd_signal", "rsi", "atr", "adx", "plus_di")
    for name, df in (("macd", R.macd(bars)), ("macd_signal", R.macd(bars)), ("rsi", R.rsi(bars)), ("atr", R.atr(bars)), ("adx", R.adx(bars)), ("plus_di", R.adx(bars))):
        assert np.allclose(one[name], series(df, "r", name)[name], equal_nan=True, rtol=1e-9), name


def plain_sar(h, l, c, step=0.02, most=0.2):
    up = c[1] >= c[0]
    s, ep, af = (min(l[:2]), max(h[:2]), step) if up else (max(h[:2]), min(l[:2]), step)
    out = [(None, 0), (s, 1 if up else -1)]
    for i in range(2, len(h)):
        s += af * (ep - s)
        s = min(s, l[i - 1], l[i - 2]) if up else max(s, h[i - 1], h[i - 2])
        if (l[i] < s) if up else (h[i] > s):
            s, ep = (max(ep, h[i], h[i - 1]), l[i]) if up else (min(ep, l[i], l[i - 1]), h[i])
            up, af = not up, step
        elif (h[i] > ep) if up else (l[i] < ep):
            ep, af = (h[i] if up else l[i]), min(af + step, most)
        out.append((s, 1 if up else -1))
    return out


def test_parabolic_stop(bars):
    for root in ("r", "s"):
        got = series(R.parabolic(bars), root, "psar", "psar_trend")
        src = series(bars, root, "high", "low", "close")
        want = plain_sar(src.high.tolist(), src.low.tolist(), src.close.tolist())
        assert np.allclose(got.psar[1:], [w[0] for w in want[1:]]) and got.psar_trend.tolist() == [w[1] for w in want]
    assert series(R.parabolic(bars), "one", "psar_trend").psar_trend.tolist() == [0]


def test_signals_look_at_no_later_bar(spark, bars):
    part = spark.createDataFrame(walk(700)[:500], BARS)
    full, cut = series(S.signal_frame(bars), "r", *S.SIGNALS)[:500], series(S.signal_frame(part), "r", *S.SIGNALS)
    assert (full.reset_index(drop=True) == cut).all().all() and (cut != 0).any().sum() >= 20


def test_market_hours_on_both_clocks(spark):
    times = {"2024-01-05 21:59": True, "2024-01-05 22:00": False, "2024-01-07 21:59": False, "2024-01-07 22:00": True, "2024-07-05 20:59": True, "2024-07-05 21:00": False, "2024-07-07 21:00": True, "2024-07-06 12:00": False}
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t), w) for t, w in times.items()], "t timestamp_ntz, w boolean")
    assert df.where(B.market_open(F.col("t")) != F.col("w")).count() == 0


# --- forecasts


def alone(name, y, steps):
    return y[-1] + M.MODELS[name](M.Ends(y, np.array([0]), np.array([len(y)])), steps)[0]


def test_series_side_by_side_give_what_each_gives_alone():
    rng = np.random.default_rng(3)
    parts = [np.cumsum(rng.standard_normal(n) * 0.01) for n in (70, 130, 900, 900, 1400, 2)]
    length = np.array([len(p) for p in parts])
    ends = M.Ends(np.concatenate(parts), np.r_[0, np.cumsum(length)[:-1]], length)
    for name, f in M.MODELS.items():
        both = f(ends, 7)
        for k, p in enumerate(parts):
            assert np.allclose(both[k], alone(name, p, 7) - p[-1], atol=1e-12), name


def test_student_distribution_by_integration():
    for nu in (1, 2, 3, 4, 5, 6, 10, 15):
        x = np.linspace(-80, 80, 320_001)
        density = (1 + x * x / nu) ** (-(nu + 1) / 2)
        area = np.r_[0, np.cumsum((density[1:] + density[:-1]) / 2)]
        for p in (0.6, 0.75, 0.9, 0.975):
            assert abs(M.quantile(p, nu) - np.interp(p, area / area[-1], x)) < 1e-5


def test_forecasts_are_made_from_whole_series(spark):
    rows = walk(1600, "long", 5)
    y = np.log([r[-1] for r in rows])
    got = {(r.model, r.h): r.bp for r in M.forecasts(spark.createDataFrame(rows, BARS), [1, 20]).collect()}
    want = {(n, h): float(alone(n, y, 20)[h - 1] - y[-1]) * 1e4 for n in M.MODELS for h in (1, 20)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert abs(want["knn", 20] - (alone("knn", y[-1100:], 20)[19] - y[-1]) * 1e4) > 1  # the older shapes matter



@pytest.mark.parametrize("name", list(M.MODELS))
def test_models_give_finite_paths_that_no_later_bar_changes(name):
    y = np.log(np.array([b[7] for b in walk(600)]))
    path = alone(name, y[:500], 10)
    assert path.shape == (10,) and np.isfinite(path).all()
    assert np.allclose(path, alone(name, y[:500].copy(), 10))
    assert np.isfinite(alone(name, y[:25], 10)).all()


def test_models_know_a_straight_line():
    y = np.linspace(0, 1, 400)
    for name in ("drift", "holt"):
        assert abs(alone(name, y, 5)[-1] - (1 + 5 / 399)) < 0.01


def test_better_models_get_more_weight(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a + 0.1 * e), float(-a), float(a), 1.0, 1.0) for a, e in rng.standard_normal((300, 2))]
    df = spark.createDataFrame(rows, "good double, bad double, a double, s double, w double").withColumn("k", F.lit(1))
    r = M.learned_weights(df, ["k"], ["good", "bad"], "a", "s", "w").first()
    assert r.w_good > 0.9 and abs(r.w_good + r.w_bad - 1) < 1e-9


def test_t_bands():
    z = M.student_bands(5)
    assert abs(z[80] - 1.2816) < 1e-9 and z[50] < 0.6745 and z[95] > 1.96
    assert abs(M.student_bands(5000)[95] - 1.96) < 0.01


# --- scores


def test_wilson_binomial_and_normal(spark):
    df = spark.createDataFrame([(8, 10), (0, 0), (500, 1000)], "h int, n int")
    low, high = P.wilson(F.col("h"), F.col("n"))
    r = df.select(low.alias("l"), high.alias("u"), P.two_sided("h", "n").alias("p")).collect()
    assert abs(r[0].l - 0.4902) < 1e-3 and abs(r[0].u - 0.9433) < 1e-3 and abs(r[0].p - 0.109375) < 1e-12
    assert (r[1].l, r[1].u, r[1].p) == (0.0, 1.0, None) and r[2].p > 0.97
    z = spark.createDataFrame([(float(x),) for x in np.linspace(-4, 4, 41)], "z double").select("z", P.normal_cdf(F.col("z")).alias("c"), P.upper_tail("z").alias("t")).toPandas()
    assert np.abs(z.c + z.t - 1).max() < 2e-7


def test_auc_by_bins_equals_pairs(spark):
    rng = random.Random(2)
    rows = [(i, round(rng.gauss(0, 3), 1), rng.random() < 0.4) for i in range(400)]
    got = P.auc(spark.createDataFrame(rows, "i int, s double, y boolean").withColumn("k", F.lit(1)), ["k"], "s", "y", "i").first().auc
    order = {i: k for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    pos, neg = [order[i] for i, _, y in rows if y], [order[i] for i, _, y in rows if not y]
    assert abs(got - sum(a > b for a in pos for b in neg) / len(pos) / len(neg)) < 1e-12


def test_weighted_quantile_is_the_lower_value(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 3.0, 2.0)], "i int, v double, w double").withColumn("k", F.lit(1))
    assert [P.weighted_quantile(df, ["k"], "v", "w", "i", q).first().value for q in (0.25, 0.5, 0.51, 1.0)] == [1.0, 2.0, 3.0, 3.0]


# --- joins


def test_asof_kinds(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("a", 30, 3), ("b", 5, 4), (None, 5, 5), ("a", None, 6)], "k string, t long, i int")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 2.0), ("a", 9, None), (None, 1, 7.0), ("a", 8, 3.0)], "k string, s long, v double")
    run = lambda **kw: {r.i: r.v for r in J.asof(left, right, ["k"], "t", "s", ["v"], **kw).collect()}
    assert run() == {1: 2.0, 2: None, 3: None, 4: None, 5: None, 6: None}
    known = right.where("v IS NOT NULL")
    go = lambda **kw: {r.i: r.v for r in J.asof(left, known, ["k"], "t", "s", ["v"], **kw).collect()}
    assert go()[2] == 3.0 and go(strict=True)[1] is None and go(tolerance=10)[3] is None and go(tolerance=22)[3] == 3.0


def test_spans_that_hold_points(spark):
    rng = random.Random(1)
    points = [(i, rng.randrange(100)) for i in range(60)]
    spans = [(i, a, a + rng.randrange(0, 30)) for i, a in enumerate(rng.randrange(100) for _ in range(40))]
    p = spark.createDataFrame(points, "i int, t long").withColumn("k", F.lit(1))
    s = spark.createDataFrame(spans, "j int, a long, z long").withColumn("k", F.lit(1))
    got = {(r.i, r.j) for r in J.within(p, s, ["k"], "t", "a", "z", 7).collect()}
    assert got == {(i, j) for i, t in points for j, a, z in spans if a <= t < z}


def test_business_days(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(12)]
    df = spark.createDataFrame([(d,) for d in days if d.weekday() < 5], "d date")
    for n in (0, 1, 4, 5, 7, 11):
        got = {r.d: r.x for r in df.select("d", J.business_add(F.col("d"), n).alias("x")).collect()}
        assert got == {d: np.busday_offset(d, n).astype(object) for d in got}


def test_alike_titles_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["euro", "dollar", "falls", "rises", "after", "data", "bank", "yen", "holds"]
    base = ["".join(rng.choice(words) for _ in range(5)) for _ in range(25)]
    items = [(i, k if rng.random() < 0.5 else k[:-3] + "xyz", rng.randrange(0, 100_000)) for i, k in enumerate(base * 4)]
    items = [*{k: (i, k, t) for i, k, t in items}.values()]
    sets = {i: ({k[j : j + 3] for j in range(max(1, len(k) - 2))}, t) for i, k, t in items}
    want = {(a, b) for a, (x, s) in sets.items() for b, (y, t) in sets.items() if a < b and abs(s - t) <= 43200 and len(x & y) / len(x | y) >= 0.6}
    got = {(r.a, r.b) for r in X.story_pairs(spark.createDataFrame(items, "id int, key string, at long")).collect()}
    assert got == want and want


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.random((230, 6))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>")
    got = vectors.nearest(rows, rows.where("id % 10 = 0"), "id", "v", 4, block=7, shard=50).toPandas()
    for q, g in got.groupby("query"):
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert g.sort_values("place").neighbour.tolist() == np.argsort(d, kind="stable")[:4].tolist()
    assert got["query"].nunique() == 23


# --- trades


def test_stop_comes_before_target_and_gaps_fill_at_the_open(spark):
    bar = "struct<open:double,high:double,low:double,close:double>"
    rows = [(1, [(100.0, 111.0, 89.0, 100.0)]), (2, [(100.0, 105.0, 99.0, 101.0), (115.0, 116.0, 114.0, 115.0)]), (3, [(100.0, 101.0, 99.0, 100.5)] * 3), (4, [(100.0, 101.0, 99.0, 100.5)])]
    df = spark.createDataFrame([("r", "p", "1d", T0, n, 1, 100.0, 90.0, 110.0, a, 3) for n, a in rows], f"root string, pair string, tf string, bar_time timestamp_ntz, n int, d int, entry double, sl double, tp double, ahead array<{bar}>, hold int")
    got = {r.n: (r.how, r.bars, round(r.r, 3)) for r in T.settled(df).collect()}
    assert got == {1: ("sl", 1, -1.0), 2: ("tp", 2, 1.5), 3: ("time", 3, 0.05)}


def test_one_position_at_a_time(spark):
    rows = [("r", "p", "1d", T0 + dt.timedelta(days=k), k, "tp", b, 1.0) for k, b in enumerate([3, 1, 1, 2, 1, 1])]
    kept = T.one_at_a_time(spark.createDataFrame(rows, "root string, pair string, tf string, bar_time timestamp_ntz, n int, how string, bars int, r double"))
    assert sorted(r.n for r in kept.collect()) == [0, 3, 5]


# --- ledger


def test_every_kind_of_tampering_is_found(spark):
    rows = [("a", i, f"p{i}") for i in range(6)] + [("b", 1, "x")]
    chain = L.chained(spark.createDataFrame(rows, "k string, i int, payload string"), "k", ["i"], "payload").toPandas()
    check = lambda df: {(r.k, r.seq, r.kind) for r in L.broken(spark.createDataFrame(df), "k").collect()}
    assert check(chain) == set()
    a = chain[chain.k == "a"].sort_values("seq").reset_index(drop=True)
    edited = a.copy(); edited.loc[2, "payload"] = "other"  # noqa: E702
    assert check(edited) == {("a", 3, "hash")}
    assert ("a", 3, "prev") in check(a.drop(index=1)) and ("a", 3, "seq") in check(a.drop(index=1))
    swapped = a.copy(); swapped.loc[[1, 2], ["payload", "prev", "hash"]] = a.loc[[2, 1], ["payload", "prev", "hash"]].to_numpy()  # noqa: E702
    assert check(swapped)
    assert L.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    with pytest.raises(ValueError):
        L.canonical({"a": float("nan")})


# --- feeds and stores


def test_chart_payloads(spark):
    def chart(stamps, close, zone="Europe/London"):
        q = {c: close for c in ("open", "high", "low", "close")}
        return json.dumps({"chart": {"result": [{"meta": {"exchangeTimezoneName": zone, "regularMarketPrice": 1.0}, "timestamp": stamps, "indicators": {"quote": [q]}}]}})

    monday = 1704067200
    payloads = [("a", chart([monday, monday + 3600, monday + 3601, monday + 7200, monday + 7200], [1.0, None, 3.0, 4.0, 5.0])), ("b", "nonsense"), ("c", None), ("d", chart([monday - 86400, monday], [1.0, 2.0]))]
    df = spark.createDataFrame(payloads, "k string, p string")
    got = {(r.k, r.at, r.close) for r in feeds.intraday_chart(df, "k", "p", monday + 7200 + 3600 + 180, 60).collect()}
    assert got == {("a", monday, 1.0), ("a", monday + 7200, 5.0), ("d", monday - 86400, 1.0), ("d", monday, 2.0)}
    assert {(r.k, str(r.day), r.close) for r in feeds.daily_chart(df, "k", "p").collect()} == {("a", "2024-01-01", 5.0), ("d", "2024-01-01", 2.0)}
    flat = spark.createDataFrame([('{"rates": {"2024-01-02": {"USD": 1.1}, "2024-01-03": {"JPY": 2}}}',)], "p string")
    assert [(str(r.day), r.high) for r in feeds.flat_rates(flat, "p", "USD").collect()] == [("2024-01-02", 1.1)]


def test_feed_items_of_three_kinds(spark):
    rss = "<rss><channel><title>feed</title><item><title>Dollar &amp; <b>yen</b></title><link>http://a</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title> </title></item></channel></rss>"
    atom = '<feed><entry><title><![CDATA[Euro up]]></title><link href="http://b"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    rdf = "<rdf:RDF><item><title>Pound</title><link>http://c</link><dc:date>2023-12-01T00:00:00Z</dc:date></item></rdf:RDF>"
    items = feeds.feed_items(spark.createDataFrame([("r", rss), ("a", atom), ("d", rdf), ("n", None)], "k string, p string"), "k", "p")
    assert {(r.k, r.title, r.link) for r in items.collect()} == {("r", "Dollar & yen", "http://a"), ("a", "Euro up", "http://b"), ("d", "Pound", "http://c")}
    kept = feeds.normalised(items, F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert {r.title for r in kept.collect()} == {"Dollar & yen", "Euro up"}
    assert feeds.first_seen(kept.union(kept)).count() == 2


def test_binary_records_and_mid(spark, tmp_path):
    rec = struct.pack(">IIIIIf", 0, 110000, 110100, 109900, 110200, 1.5) + struct.pack(">IIIIIf", 3600, 1, 1, 1, 1, 0.0)
    (tmp_path / "x.bin").write_bytes(lzma.compress(rec))
    (tmp_path / "y.bin").write_bytes(b"broken")
    bid = feeds.hourly_records(spark.read.format("binaryFile").load(str(tmp_path)), 1e5)
    assert [(r.second, r.open, r.high, r.low, r.close) for r in bid.collect()] == [(0, 1.1, 1.102, 1.099, 1.101)]
    ask = bid.withColumns({c: F.col(c) + 0.002 for c in ("open", "high", "low", "close")})
    m = feeds.mid_bars(bid, ask, ["second"]).first()
    assert abs(m.close - 1.102) < 1e-9 and abs(m.spread - 0.002) < 1e-9


def test_stores_only_add_what_is_new(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = spark.createDataFrame(walk(10), BARS)
    stores.append_new_bars(rows.where(F.col("bar_time") < F.lit(T0 + dt.timedelta(days=6))), path)
    stores.append_new_bars(rows, path)
    stores.append_new_bars(rows, path)
    assert spark.read.parquet(path).count() == 10
    items = spark.createDataFrame([("x", T0), ("x", T0 + dt.timedelta(days=1)), ("y", T0)], "id string, fetched_at timestamp_ntz")
    at = str(tmp_path / "items")
    stores.append_new_items(items, at)
    stores.append_new_items(items.withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 30 DAYS")), at)
    stores.append_new_items(items.withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 90 DAYS")), at)
    assert spark.read.parquet(at).count() == 4 and stores.items_since(spark, at, "2024-02-01").count() == 2


# --- streams


def test_streams_give_what_batches_give(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, T0 + dt.timedelta(seconds=i * 40), rng.choice("ab"), float(rng.randrange(100))) for i in range(400)]
    schema = "i long, t timestamp, k string, v double"
    source = str(tmp_path / "in")
    for n in range(4):
        spark.createDataFrame(rows[n * 100 : (n + 1) * 100], schema).coalesce(1).write.mode("append").parquet(source)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    read = lambda: Z.ticks(spark, source, schema, "t", 1)
    Z.drained(Z.tumbling_bars(read(), "k", "t", "v", "i", "15 minutes"), out, check).awaitTermination()
    got = spark.read.parquet(out).select("k", "bar_time", "open", "high", "low", "close", "ticks").toPandas()
    df = pd.DataFrame(rows, columns=["i", "t", "k", "v"])
    want = df.groupby(["k", df.t.dt.floor("15min")]).v.agg(["first", "max", "min", "last", "count"]).reset_index()
    done = want[want.t + pd.Timedelta(minutes=18) <= df.t.max()]
    assert len(got) >= len(done) > 0 and not got.duplicated(["k", "bar_time"]).any()
    met = got.merge(want, left_on=["k", "bar_time"], right_on=["k", "t"])
    assert len(met) == len(got) and (met.open == met["first"]).all() and (met.close == met["last"]).all() and (met.ticks == met["count"]).all()
    again = str(tmp_path / "again")
    Z.drained(Z.first_of_id(read().withColumn("id", F.col("i") % 50), "id", "t"), again, str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(again).count() == 50
    slid = str(tmp_path / "slid")
    Z.drained(Z.sliding_sums(read(), "k", "t", "v", "1 hour", "30 minutes", "1 minute"), slid, str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(slid).count() > 0
