"""Reading of headlines."""

import pytest

from quillon.operators import news as N

SAYS = [
    ("Dollar rises against the yen as payrolls beat forecasts", {"USD": 1, "JPY": -1}), ("EUR slipped after the Bank of England decision", {"EUR": -1}), ("GBP/JPY jumps to 190", {"GBP": 1, "JPY": -1}), ("USDCAD falls", {"USD": -1, "CAD": 1}),
    ("Rupee falls against the dollar", {}), ("Euro fails to rally", {}), ("Australian dollar rallies", {"AUD": 1}), ("Fed raises rates", {"USD": 1}), ("Fed did not raise rates", {"USD": -1}), ("ECB rate cut bets fade", {"EUR": 1}),
    ("Trump urges Fed to cut rates", {}), ("Will the RBA raise rates?", {}), ("Bank of Canada cuts rates", {"CAD": -1}), ("Stocks drop on war fears", {"JPY": 1, "USD": 1, "CHF": 1, "AUD": -1, "NZD": -1}), ("Yen intervention warning", {"JPY": 1}), ("A weaker pound", {"GBP": -1}),
    ("Hong Kong dollar rises", {}), ("Yen slides; pound gains", {"JPY": -1, "GBP": 1}), ("", {}), (None, {}), ("Copper prices rise", {}),
]
SAYS_JA = [("豪ドル上昇した　米連邦準備制度の決定受け", {"AUD": 1}), ("円安進む", {"JPY": -1}), ("ドル円が反落", {"USD": -1, "JPY": 1}), ("ユーロ/ポンド、続伸", {"EUR": 1, "GBP": -1}), ("日銀、利上げ見送り", {"JPY": -1}), ("米国で利上げ観測", {"USD": 1}), ("株安でリスク回避", {"JPY": 1, "USD": 1, "CHF": 1, "AUD": -1, "NZD": -1}), ("政府が為替介入、円", {"JPY": 1})]


@pytest.mark.parametrize("title,want", SAYS)
def test_english(title, want):
    assert {c: (1 if s > 0 else -1) for c, s in N.read(title, False).items()} == want


@pytest.mark.parametrize("title,want", SAYS_JA)
def test_japanese(title, want):
    assert {c: (1 if s > 0 else -1) for c, s in N.read(title, True).items()} == want


def test_the_nearest_name_takes_a_cue_and_others_absorb_it():
    line = N.units("Turkey rate cut, ECB waits")
    assert N.nearest(line, 1) is None and N.nearest(line, 3) == "EUR"


def test_frames(spark):
    rows = [(1, "Dollar rises"), (2, "Dollar rises"), (3, None), (4, ""), (5, "円安進む"), (6, "x" * 100_000)]
    got = {(r.i, r.cur, r.score > 0) for r in N.scores(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()}
    assert got == {(1, "USD", True), (2, "USD", True), (5, "JPY", False)}
    p = spark.createDataFrame([("d", "USD", 0.9), ("d", "JPY", -0.8), ("e", "EUR", 0.2)], "day string, cur string, pressure double")
    pairs = spark.createDataFrame([("USDJPY", "USD", "JPY"), ("EURUSD", "EUR", "USD"), ("AUDNZD", "AUD", "NZD")], "pair string, base string, quote string")
    assert {(r.day, r.pair): round(r.signal, 6) for r in N.pair_signals(p, pairs, ["day"]).collect()} == {("d", "USDJPY"): 1.0, ("d", "EURUSD"): -0.9, ("e", "EURUSD"): 0.2}
