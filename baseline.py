"""

    python baseline.py [FOLDER]
"""

from __future__ import annotations

import json
import sys
import time

import numpy as np
import pandas as pd

KEY = ["root", "pair", "tf"]
PRICES = ["open", "high", "low", "close"]


def bars(folder: str) -> pd.DataFrame:
    p = pd.read_parquet(f"{folder}/prices.parquet", columns=["line_id", *KEY, "bar_time", *PRICES, "fetched_at"])
    p["pair"] = p["pair"].str.replace("/", "").str.replace("_", "").str.upper()
    p = p[p["close"].notna() & p["bar_time"].notna() & ~(p[PRICES].min(axis=1) <= 0)]
    p = p.sort_values([*KEY, "bar_time", "fetched_at", "line_id"], na_position="first").drop_duplicates([*KEY, "bar_time"], keep="last")
    for c in ("open", "high", "low"):
        p[c] = p[c].fillna(p["close"])
    p["high"], p["low"] = p[PRICES].max(axis=1), p[PRICES].min(axis=1)
    return p.reset_index(drop=True)


def bars_4h(folder: str) -> pd.DataFrame:
    b = bars(folder)
    b = b[b["tf"] == "1h"]
    return b.groupby([*KEY, b["bar_time"].dt.floor("4h")]).agg({"open": "first", "high": "max", "low": "min", "close": "last"})


def bollinger(folder: str) -> pd.DataFrame:
    b = bars(folder)
    r = b.groupby(KEY)["close"].rolling(20)
    mid, sd = r.mean(), r.std(ddof=0)
    return pd.DataFrame({"low": mid - 2 * sd, "mid": mid, "up": mid + 2 * sd})


def averaged(b: pd.DataFrame, column: str, alpha: float) -> pd.Series:
    return b.groupby(KEY)[column].transform(lambda x: x.ewm(alpha=alpha, adjust=False).mean())


def rsi(folder: str) -> pd.Series:
    b = bars(folder)
    move = b.groupby(KEY)["close"].diff()
    b["gain"], b["loss"] = move.clip(lower=0), -move.clip(upper=0)
    return 100 - 100 / (1 + averaged(b, "gain", 1 / 14) / averaged(b, "loss", 1 / 14))


def macd(folder: str) -> pd.Series:
    b = bars(folder)
    b["macd"] = averaged(b, "close", 2 / 13) - averaged(b, "close", 2 / 27)
    return b["macd"] - averaged(b, "macd", 0.2)


def asof_price(folder: str) -> pd.DataFrame:
    b = bars(folder)
    b = b[b["tf"] != "1d"]
    b["ends"] = b["bar_time"] + pd.to_timedelta(b["tf"].map({"15m": 15, "1h": 60}), unit="m")
    b["ends"] = b["ends"].astype("datetime64[us]")
    q = pd.read_parquet(f"{folder}/quotes.parquet", columns=["quote_id", *KEY, "quote_time"]).dropna(subset=["quote_time"])
    q["pair"] = q["pair"].str.replace("/", "").str.replace("_", "").str.upper()
    q["quote_time"] = q["quote_time"].astype("datetime64[us]")
    return pd.merge_asof(q.sort_values("quote_time"), b.sort_values("ends")[[*KEY, "ends", "close"]], left_on="quote_time", right_on="ends", by=KEY)


def p1_found(folder: str) -> pd.DataFrame:
    p = pd.read_parquet(f"{folder}/prices.parquet", columns=[*KEY, "bar_time", "close"]).dropna(subset=["bar_time", "close"])
    p["pair"] = p["pair"].str.replace("/", "").str.replace("_", "").str.upper()
    n = p.drop_duplicates([*KEY, "bar_time"]).groupby([*KEY, p["bar_time"].dt.floor("D")]).size()
    out = []
    for key, s in n.groupby(level=[0, 1, 2]):
        s = s.droplevel([0, 1, 2]).asfreq("D", fill_value=0)
        thin = (60 * s.rolling(7).sum() < 7 * s.rolling(30).sum()) & (np.arange(len(s)) >= 29)
        out.append(pd.DataFrame({"key": [key] * int(thin.sum()), "day": s.index[thin]}))
    return pd.concat(out)


def hit_scores(folder: str) -> pd.DataFrame:
    b = bars(folder)
    log = np.log(b["close"])
    x = log.groupby([b[k] for k in KEY]).diff() * 1e4
    y = x.groupby([b[k] for k in KEY]).shift(-1)
    d = pd.DataFrame({"tf": b["tf"], "hit": (x * y > 0).astype(float), "e": (0.1 * x - y) ** 2})[x.notna() & y.notna()]
    return d.groupby("tf").mean()


def densify_calendar(folder: str) -> pd.DataFrame:
    b = bars(folder)
    b = b[b["tf"] == "1h"]
    n = b.groupby(["root", "pair", b["bar_time"].dt.floor("D")]).size()
    return pd.concat([s.droplevel([0, 1]).asfreq("B", fill_value=0) for _, s in n.groupby(level=[0, 1])])


QUERIES = {"p1_found": p1_found, "fix_ohlc": bars, "bars_4h": bars_4h, "bollinger": bollinger, "rsi": rsi, "macd": macd, "asof_price": asof_price, "densify_calendar": densify_calendar, "hit_scores": hit_scores}


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    took = {}
    for name, query in QUERIES.items():
        begin = time.time()
        query(folder)
        took[name] = round(time.time() - begin, 3)
    print(json.dumps({"folder": folder, "queries": took}))


if __name__ == "__main__":
    main()
