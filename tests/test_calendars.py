"""Calendar rules against known days."""

import datetime as dt

from quillon.operators import calendars as C
from quillon.plans import studying as P

D = dt.date


def test_easter():
    assert [C.easter(y) for y in (2000, 2008, 2019, 2024, 2025, 2038)] == [D(2000, 4, 23), D(2008, 3, 23), D(2019, 4, 21), D(2024, 3, 31), D(2025, 4, 20), D(2038, 4, 25)]


def test_known_holidays():
    assert {D(2021, 7, 5), D(2021, 11, 25), D(2022, 6, 20)} <= C.holidays("USD", 2021) | C.holidays("USD", 2022)
    assert D(2021, 6, 18) not in C.holidays("USD", 2021) and D(2022, 1, 1) not in C.holidays("USD", 2022)
    assert {D(2022, 1, 3), D(2022, 6, 2), D(2022, 6, 3), D(2022, 9, 19), D(2022, 12, 27)} <= C.holidays("GBP", 2022)
    assert {D(2024, 3, 29), D(2024, 4, 1), D(2024, 5, 1)} <= C.holidays("EUR", 2024)
    assert {D(2024, 2, 12), D(2024, 8, 12), D(2024, 9, 23), D(2019, 4, 30), D(2019, 5, 2), D(2021, 7, 22)} <= C.holidays("JPY", 2024) | C.holidays("JPY", 2019) | C.holidays("JPY", 2021)
    assert D(2022, 9, 22) in C.holidays("AUD", 2022) and D(2022, 1, 3) in C.holidays("AUD", 2022)


def test_spot_dates():
    closed = {c: C.holidays(c, 2024) | C.holidays(c, 2025) for c in C.RULES}
    assert C.spot_date(D(2024, 1, 9), "EUR", "USD", closed) == D(2024, 1, 11)
    assert C.spot_date(D(2024, 1, 12), "EUR", "USD", closed) == D(2024, 1, 16)  # the dollar's Monday holiday
    assert C.spot_date(D(2024, 5, 1), "USD", "JPY", closed) == D(2024, 5, 7)  # the yen's holidays


def test_holidays_of_francs_and_dollars_of_canada_and_new_zealand():
    assert C.holidays("CHF", 2024) == {D(2024, 1, 1), D(2024, 1, 2), D(2024, 3, 29), D(2024, 4, 1), D(2024, 5, 9), D(2024, 5, 20), D(2024, 5, 1), D(2024, 8, 1), D(2024, 12, 25), D(2024, 12, 26)}
    assert C.holidays("CAD", 2022) == {D(2022, 1, 3), D(2022, 2, 21), D(2022, 4, 15), D(2022, 5, 23), D(2022, 7, 1), D(2022, 8, 1), D(2022, 9, 5), D(2022, 9, 30), D(2022, 10, 10), D(2022, 11, 11), D(2022, 12, 26), D(2022, 12, 27)}
    assert {D(2023, 7, 3), D(2023, 10, 2), D(2023, 11, 13), D(2021, 5, 24)} <= C.holidays("CAD", 2023) | C.holidays("CAD", 2021)
    assert C.holidays("NZD", 2022) == {D(2022, 1, 3), D(2022, 1, 4), D(2022, 1, 24), D(2022, 1, 31), D(2022, 2, 7), D(2022, 4, 15), D(2022, 4, 18), D(2022, 4, 25), D(2022, 6, 6), D(2022, 6, 24), D(2022, 9, 26), D(2022, 10, 24), D(2022, 12, 26), D(2022, 12, 27)}
    assert {D(2026, 1, 19), D(2026, 1, 26), D(2026, 4, 27), D(2026, 7, 10)} <= C.holidays("NZD", 2026) and D(2010, 4, 25) in C.holidays("NZD", 2010)


def test_next_day_rule():
    closed = {c: C.holidays(c, 2024) | C.holidays(c, 2025) for c in C.RULES}
    assert C.spot_next_day(D(2024, 6, 28), "USD", "CAD", closed) == D(2024, 7, 2)  # Canada Day
    assert C.spot_date(D(2024, 6, 27), "USD", "CAD", closed) == D(2024, 7, 2)


def test_every_daily_bar_has_its_row(spark, tmp_path):
    at = lambda *d: dt.datetime(*d)
    bars = [("r", p, "1d", t) for p in ("USDCAD", "NZDUSD", "CHFJPY", "EURSEK") for t in (at(2024, 6, 28), at(2018, 6, 28), at(2029, 12, 28))]
    rows = [(i, *b, 1.0, 1.0, 1.0, 1.0, None, b[3]) for i, b in enumerate(bars)]
    spark.createDataFrame(rows, "line_id long, root string, pair string, tf string, bar_time timestamp_ntz, open double, high double, low double, close double, spread double, fetched_at timestamp_ntz").write.parquet(str(tmp_path / "prices.parquet"))
    spark.createDataFrame([(b + q, b, q) for b, q in (("USD", "CAD"), ("NZD", "USD"), ("CHF", "JPY"), ("EUR", "SEK"))], "code string, base string, quote string").write.parquet(str(tmp_path / "fx_pairs.parquet"))
    got = {(r.pair, r.day): r for r in P.spot_dates(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and all((r.spot is None) == (p == "EURSEK") and (r.spot_t1 is None) == (p != "USDCAD") for (p, _), r in got.items())
    r = got["USDCAD", "2024-06-28"]
    assert (r.spot, r.roll_days, r.spot_t1, r.roll_days_t1) == ("2024-07-03", 0, "2024-07-02", 0)  # the holiday's Monday has the same value dates
    days = P.holidays(spark, str(tmp_path)).collect()
    assert {r.cur for r in days} == set(C.RULES) and {r.day.year for r in days} >= set(range(2018, 2031))


def test_grid_numbers_open_hours(spark):
    rows = C.trading_grid(spark, "2024-01-05", "2024-01-08", 60).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
    assert [r.slot for r in rows if r.slot.weekday() == 4][-1].hour == 21 and next(r.slot for r in rows if r.slot.weekday() == 6).hour == 22
