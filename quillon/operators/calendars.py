"""Calendar dimensions: bank holidays by rule, spot dates, and the grid of open-market slots."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.operators.bars import market_open

DAY = dt.timedelta(days=1)
MON, THU, SUN = 0, 3, 6


def easter(year: int) -> dt.date:
    """Easter Sunday from the golden number and the epact."""
    golden, century = year % 19 + 1, year // 100 + 1
    dropped, moon = 3 * century // 4 - 12, (8 * century + 5) // 25 - 5
    sunday = 5 * year // 4 - dropped - 10
    epact = (11 * golden + 20 + moon - dropped) % 30
    epact += (epact == 25 and golden > 11) or epact == 24
    full = 44 - epact
    full += 30 * (full < 21)
    return dt.date(year, 3, 1) + DAY * (full + 6 - (sunday + full) % 7)


def weekday_of(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month; the last for n = -1."""
    first = dt.date(year, month, 1)
    days = [first + DAY * k for k in range(31) if (first + DAY * k).month == month and (first + DAY * k).weekday() == weekday]
    return days[n - 1 if n > 0 else n]


@dataclass(frozen=True)
class Rule:
    """A holiday in the years it holds: a fixed day, an n-th weekday, a weekday on or before a day, a distance to
    Easter, or a day by year. ``monday``: on a weekend it is the Monday after."""

    month: int = 0
    day: int = 0
    weekday: int = -1
    n: int = 0
    after_easter: int | None = None
    since: int = 0
    until: int = 9999
    but: tuple[int, ...] = ()
    monday: bool = False

    def on(self, year: int) -> dt.date | None:
        if not self.since <= year <= self.until or year in self.but:
            return None
        if self.after_easter is not None:
            return easter(year) + DAY * self.after_easter
        if self.n:
            return weekday_of(year, self.month, self.weekday, self.n)
        day = dt.date(year, self.month, self.day)
        if self.weekday >= 0:
            return day - DAY * ((day.weekday() - self.weekday) % 7)
        return day + DAY * (7 - day.weekday()) if self.monday and day.weekday() > 4 else day


def fixed(month: int, day: int, **kw) -> Rule:
    return Rule(month, day, **kw)


def nth(month: int, weekday: int, n: int, **kw) -> Rule:
    return Rule(month, weekday=weekday, n=n, **kw)


def until_day(month: int, day: int, weekday: int, **kw) -> Rule:
    return Rule(month, day, weekday=weekday, **kw)


def once(year: int, month: int, day: int) -> Rule:
    return Rule(month, day, since=year, until=year)


GOOD_FRIDAY, EASTER_MONDAY = Rule(after_easter=-2), Rule(after_easter=1)
NEW_YEAR, CHRISTMAS, BOXING = fixed(1, 1), fixed(12, 25), fixed(12, 26)
GAMES = (2020, 2021)  # years in which Japan moved summer holidays
# fixed values: the days on which banks are closed, by currency
RULES: dict[str, list[Rule]] = {
    "USD": [NEW_YEAR, fixed(6, 19, since=2022), fixed(7, 4), fixed(11, 11), CHRISTMAS, nth(1, MON, 3), nth(2, MON, 3), nth(5, MON, -1), nth(9, MON, 1), nth(10, MON, 2), nth(11, THU, 4)],
    "EUR": [NEW_YEAR, GOOD_FRIDAY, EASTER_MONDAY, fixed(5, 1), CHRISTMAS, BOXING],
    "GBP": [
        NEW_YEAR, CHRISTMAS, BOXING, GOOD_FRIDAY, EASTER_MONDAY, nth(5, MON, 1, but=(2020,)), once(2020, 5, 8), nth(5, MON, -1, but=(2012, 2022)), once(2012, 6, 4), once(2022, 6, 2), nth(8, MON, -1),
        once(2011, 4, 29), once(2012, 6, 5), once(2022, 6, 3), once(2022, 9, 19), once(2023, 5, 8),
    ],
    "AUD": [NEW_YEAR, fixed(1, 26), CHRISTMAS, BOXING, GOOD_FRIDAY, EASTER_MONDAY, fixed(4, 25), nth(6, MON, 2), nth(8, MON, 1), nth(10, MON, 1), once(2022, 9, 22)],
    "JPY": [
        NEW_YEAR, nth(1, MON, 2), fixed(2, 11), fixed(2, 23, since=2020), fixed(4, 29), fixed(5, 3), fixed(5, 4, since=2007), fixed(5, 5), nth(7, MON, 3, but=GAMES), fixed(8, 11, since=2016, but=GAMES),
        nth(9, MON, 3), nth(10, MON, 2, but=GAMES), fixed(11, 3), fixed(11, 23), fixed(12, 23, until=2018), once(2019, 5, 1), once(2019, 10, 22), once(2020, 7, 23), once(2020, 7, 24), once(2020, 8, 10),
        once(2021, 7, 22), once(2021, 7, 23), once(2021, 8, 8),
    ],
    "CHF": [NEW_YEAR, fixed(1, 2), GOOD_FRIDAY, EASTER_MONDAY, Rule(after_easter=39), Rule(after_easter=50), fixed(5, 1), fixed(8, 1), CHRISTMAS, BOXING],
    "CAD": [
        fixed(1, 1, monday=True), GOOD_FRIDAY, until_day(5, 24, MON), fixed(7, 1, monday=True), nth(8, MON, 1), nth(9, MON, 1), nth(10, MON, 2), fixed(11, 11, monday=True), CHRISTMAS, BOXING,
        nth(2, MON, 3, since=2008), fixed(9, 30, since=2021, monday=True),
    ],
    # the Mondays nearest 22 and 29 January; the new year's star feast is known to 2026
    "NZD": [
        NEW_YEAR, fixed(1, 2), until_day(1, 25, MON), until_day(2, 1, MON), GOOD_FRIDAY, EASTER_MONDAY, nth(6, MON, 1), nth(10, MON, 4), CHRISTMAS, BOXING,
        fixed(2, 6, until=2013), fixed(2, 6, since=2014, monday=True), fixed(4, 25, until=2013), fixed(4, 25, since=2014, monday=True),
        once(2022, 6, 24), once(2022, 9, 26), once(2023, 7, 14), once(2024, 6, 28), once(2025, 6, 20), once(2026, 7, 10),
    ],
}
MOVABLE = {"GBP": {(1, 1), (12, 25), (12, 26)}, "AUD": {(1, 1), (1, 26), (12, 25), (12, 26)}, "CAD": {(12, 25), (12, 26)}, "NZD": {(1, 1), (1, 2), (12, 25), (12, 26)}}  # moved off weekends to the next free weekday


def equinoxes(year: int) -> list[dt.date]:
    """Spring and autumn equinox in Japan, 1980 to 2099; fixed values: the constants of the approximation."""
    drift = 0.242194 * (year - 1980) - (year - 1980) // 4
    return [dt.date(year, 3, int(20.8431 + drift)), dt.date(year, 9, int(23.2488 + drift))]


def holidays(currency: str, year: int) -> set[dt.date]:
    days = {d for r in RULES[currency] if (d := r.on(year))}
    if currency == "USD":
        return {d + DAY if d.weekday() == SUN else d for d in days if d.weekday() != 5}
    if currency == "JPY":
        return japanese(days | set(equinoxes(year)), year)
    movable = MOVABLE.get(currency, set())
    late = sorted(d for d in days if d.weekday() > 4 and (d.month, d.day) in movable)
    days -= set(late)
    for d in late:
        days.add(next(d + DAY * k for k in range(1, 9) if (d + DAY * k).weekday() < 5 and d + DAY * k not in days))
    return days


def japanese(named: set[dt.date], year: int) -> set[dt.date]:
    """The year's named days with those that follow from them: days between two of them, the day for one on a Sunday, and
    the banks' own days at the turn of the year. Worked out on a row of marks, one a day."""
    first = dt.date(year, 1, 1)
    marks = np.zeros(377, dtype=bool)  # a few days of the next year too
    marks[[(d - first).days for d in named]] = True
    sunday = (np.arange(len(marks)) + first.weekday()) % 7 == SUN
    between = np.r_[False, marks[:-1]] & np.r_[marks[1:], False] & ~sunday
    marks |= between
    for late in np.flatnonzero(marks & sunday):
        marks[late + int(np.argmin(marks[late:]))] = True
    return {first + DAY * int(k) for k in np.flatnonzero(marks)} | {dt.date(year, 1, 2), dt.date(year, 1, 3), dt.date(year, 12, 31)}


def holiday_table(spark: SparkSession, years: range) -> DataFrame:
    """cur, day: some fifty rows a year, built on the driver."""
    rows = [(cur, day) for cur in RULES for year in years for day in sorted(holidays(cur, year))]
    return spark.createDataFrame(rows, "cur string, day date")


class BusinessDays:
    """Which days are open in each currency from a first day on, as a row of marks, and look-ups of the next open day."""

    def __init__(self, first: dt.date, last: dt.date, closed: dict[str, set[dt.date]] | None = None):
        closed = closed or {c: set().union(*(holidays(c, y) for y in range(first.year, last.year + 1))) for c in RULES}
        self.first, self.size = first, (last - first).days + 1
        weekend = (np.arange(self.size) + first.weekday()) % 7 > 4
        self.open: dict[str, np.ndarray] = {}
        for currency, days in closed.items():
            marks = ~weekend
            marks[[(day - first).days for day in days if first <= day <= last]] = False
            self.open[currency] = marks

    def following(self, currencies: set[str]) -> np.ndarray:
        """For each day the first day, it or a later one, that is open in all the currencies; past the end the end."""
        both = np.logical_and.reduce([self.open[c] for c in sorted(currencies)])
        at = np.where(both, np.arange(self.size), self.size - 1)
        return np.minimum.accumulate(at[::-1])[::-1]

    def spots(self, base: str, quote: str, days: int) -> np.ndarray:
        """Value day of a trade on each day: ``days`` open days on, those before the last of the currencies without the
        dollar, the last of both and the dollar."""
        every = self.following({base, quote, "USD"})
        others = self.following({base, quote} - {"USD"})
        step = lambda at, row: row[np.minimum(at + 1, self.size - 1)]
        at = np.arange(self.size)
        for _ in range(days - 1):
            at = step(at, others)
        return step(at, every)


def value_day(trade: dt.date, base: str, quote: str, closed: dict[str, set[dt.date]], days: int) -> dt.date:
    """Value day of one trade under the days that each currency is closed."""
    return trade + DAY * int(BusinessDays(trade, trade + DAY * 60, closed).spots(base, quote, days)[0])


def spot_date(trade: dt.date, base: str, quote: str, closed: dict[str, set[dt.date]]) -> dt.date:
    """Two business days on."""
    return value_day(trade, base, quote, closed, 2)


def spot_next_day(trade: dt.date, base: str, quote: str, closed: dict[str, set[dt.date]]) -> dt.date:
    """The next business day of both currencies and the dollar, the market's way for USDCAD."""
    return value_day(trade, base, quote, closed, 1)


NEXT_DAY = {"USDCAD"}


def spot_table(spark: SparkSession, pairs: list[tuple[str, str]], years: range) -> DataFrame:
    """pair, day, spot, roll_days for each day and pair whose calendars are known: a bounded dimension.

    ``spot_t1`` and ``roll_days_t1`` are by the next-day rule, for the pairs that the market settles so.
    """
    first, last = dt.date(years[0], 1, 1), dt.date(years[-1], 12, 31)
    table = BusinessDays(first, last + DAY * 60)
    rows = []
    for base, quote in pairs:
        if base in RULES and quote in RULES:
            columns = []
            for days in (2, 1):
                spot = table.spots(base, quote, days) if days == 2 or base + quote in NEXT_DAY else None
                columns.append(spot)
            for i in range((last - first).days + 1):
                nxt, found = i + (3 if (first + DAY * i).weekday() == 4 else 1), []
                for spot in columns:
                    found += [None, None] if spot is None else [first + DAY * int(spot[i]), int(spot[nxt] - spot[i])]
                rows.append((base + quote, first + DAY * i, *found))
    return spark.createDataFrame(rows, "pair string, day date, spot date, roll_days int, spot_t1 date, roll_days_t1 int")


def trading_grid(spark: SparkSession, first: str, last: str, minutes: int) -> DataFrame:
    """slot, seq: the open-market slots from ``first`` to ``last`` (days) in order, numbered from 1.

    The slots of each day are numbered in the day and the days' counts are summed up, so no task numbers them all.
    """
    return trading_slots(spark.range(1).select(F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last")), minutes)


def trading_slots(span: DataFrame, minutes: int) -> DataFrame:
    """The same from the one row of ``span`` (first, last): nothing is collected while the query is declared."""
    ends = [F.col("first").cast("timestamp_ntz"), F.timestamp_add("SECOND", F.lit(86_399), F.col("last").cast("timestamp_ntz"))]
    slots = span.where(F.col("first").isNotNull()).select(F.explode(F.sequence(*ends, F.expr(f"INTERVAL {minutes} MINUTES"))).alias("slot"))
    open_ = slots.where(market_open(F.col("slot"))).withColumn("day", F.to_date("slot"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = open_.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("slot"))
    return open_.withColumn("place", place).join(days, "day").select("slot", (F.col("place") + F.col("ahead")).cast("long").alias("seq"))
