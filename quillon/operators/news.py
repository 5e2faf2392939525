"""Reading of headlines: which currencies they name, which way they say these move, and what else speaks for them.

A headline is cut into words; names and cues of several words become one unit, the longest first. Every unit has a role,
and a few rules over the sequence of roles give each currency a sum, which is drawn to -1..1. Japanese has no blanks:
there the units are found in the letters.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# --- fixed values: names and cues, and what they stand for -----------------------------------------------------------

CURRENCY = {
    "USD": "us dollar|u.s. dollar|dollar|greenback|usd|dollar index", "JPY": "yen|japanese yen|jpy", "EUR": "euro|single currency|eur", "GBP": "sterling|pound sterling|british pound|pound|gbp|cable",
    "AUD": "australian dollar|aussie dollar|aussie|aud", "NZD": "new zealand dollar|kiwi|nzd", "CAD": "canadian dollar|loonie|cad", "CHF": "swiss franc|swissie|franc|chf",
}
INSTITUTION = {
    "USD": "federal reserve|fed|fomc|treasury|treasuries|us payrolls|nonfarm payrolls|payrolls", "JPY": "bank of japan|boj|ministry of finance|japan", "EUR": "european central bank|ecb|euro zone|euro area|eurozone|bunds", "GBP": "bank of england|boe|gilts|uk|britain",
    "AUD": "reserve bank of australia|rba|australia", "NZD": "reserve bank of new zealand|rbnz|new zealand", "CAD": "bank of canada|boc|canada", "CHF": "swiss national bank|snb|switzerland",
}
ELSEWHERE = "hong kong dollar|singapore dollar|taiwan dollar|rupee|yuan|renminbi|won|peso|lira|ruble|rouble|real|rand|baht|rupiah|ringgit|krona|zloty|forint|pboc|rbi|turkey|india|china|brazil|mexico"
ROLES = {
    "up": "rises|rise|rose|rising|gains|gain|gained|climbs|climb|climbed|jumps|jump|jumped|surges|surge|surged|advances|advance|advanced|firms|firm|firmed|strengthens|strengthen|strengthened|rallies|rally|rallied|rebounds|rebound|rebounded|soars|edges higher|edged higher|moves higher|bullish|recovers",
    "down": "falls|fall|fell|falling|drops|drop|dropped|slips|slip|slipped|slides|slide|slid|eases|ease|eased|weakens|weaken|weakened|declines|decline|declined|retreats|retreat|retreated|tumbles|tumble|tumbled|sinks|sink|sank|plunges|edges lower|edged lower|moves lower|drifted lower|drifts lower|bearish|selloff|weakness",
    "push_up": "boosts|lifts|supports|buoys|props up|stronger|firmer", "push_down": "weighs on|pressures|hits|drags|sinks the|weaker|softer",
    "hawk": "raises rates|raise rates|rate hike|rate hikes|hikes rates|hike rates|hawkish|tightening|rate rise|higher rates", "dove": "cuts rates|cut rates|rate cut|rate cuts|dovish|easing|stimulus|lower rates",
    "beat": "beats forecasts|beat forecasts|beats expectations|tops forecasts|hotter than expected|stronger than expected|above forecast", "miss": "misses forecasts|miss forecasts|misses expectations|cooler than expected|weaker than expected|below forecast",
    "not": "not|no|never|didn't|doesn't|won't|unlikely|denies|rules out|fails to|fail to|pauses|without", "fade": "fade|fades|dims|douse|douses|cool|cools|trims|unwinds|evaporate", "against": "against|versus|vs|to",
    "break": "as|while|after|amid|but|despite|when|because|on|;|,|:|—|–|-", "wish": "urges|calls for|wants|demands|will|should|could|would|may|?",
    "off": "safe haven|safe-haven|risk aversion|risk-off|stocks drop|stocks slide|stocks fall|dow drops|wall street slides", "on": "risk-on|risk appetite|stocks rise|stocks rally|stocks gain|wall street rallies",
    "intervene": "intervention|intervenes|rate check|warns against",
}
WEIGHT = {"hawk": 0.8, "dove": -0.8, "beat": 0.6, "miss": -0.6}
AVERSE = {"JPY": 0.5, "USD": 0.3, "CHF": 0.3, "AUD": -0.5, "NZD": -0.5}  # what fear does to each currency
JA_CURRENCY = {
    "USD": "米ドル|ドル|米連邦準備制度|米国|FRB|FOMC", "JPY": "円相場|円|日銀|日本銀行", "EUR": "ユーロ|欧州中銀|ECB", "GBP": "英ポンド|ポンド|英中銀", "AUD": "豪ドル|豪中銀", "NZD": "NZドル|ニュージーランドドル", "CAD": "加ドル|カナダドル", "CHF": "スイスフラン",
}
JA_NAMES = frozenset("米ドル ドル 円相場 円 ユーロ 英ポンド ポンド 豪ドル NZドル ニュージーランドドル 加ドル カナダドル スイスフラン".split())
JA_ROLES = {
    "up": "上昇|反発|続伸|急伸|強含|高|買い|堅調|小幅高|急騰", "down": "下落|反落|続落|急落|弱含|安|売り|軟調|小幅安|急反落", "hawk": "利上げ|引き締め|タカ派", "dove": "利下げ|金融緩和|ハト派", "beat": "予想を上回|予想を大幅に上回|上振れ", "miss": "予想を下回|予想を大幅に下回|下振れ",
    "not": "ならず|つながらず|否定|見送り|せず|後退|限定的", "break": "、|。|　|；|で ", "off": "リスク回避|株安", "on": "リスク選好|株高", "intervene": "為替介入|介入警戒|けん制|レートチェック",
}
REACH = 6  # words within which a move belongs to a currency


@dataclass(frozen=True)
class Unit:
    role: str  # "currency", "bank", "elsewhere", "pair", a key of ROLES, or "word"
    of: tuple[str, ...] = ()


def phrases() -> dict[tuple[str, ...], Unit]:
    out: dict[tuple[str, ...], Unit] = {}
    for role, table in (("bank", INSTITUTION), ("currency", CURRENCY)):
        for code, names in table.items():
            out |= {tuple(n.split()): Unit(role, (code,)) for n in names.split("|")}
    out |= {tuple(n.split()): Unit("elsewhere") for n in ELSEWHERE.split("|")}
    for role, cues in ROLES.items():
        out |= {tuple(c.split()): Unit(role) for c in cues.split("|") if tuple(c.split()) not in out}
    return out


WORD = regex.compile(r"[a-z]{3}/[a-z]{3}|[\p{L}][\p{L}.'’-]*|\d[\d.,]*|[^\w\s]")
CODES = frozenset(CURRENCY)
PHRASES = phrases()
LONGEST = max(map(len, PHRASES))


def units(title: str) -> list[Unit]:
    """The headline as units, the longest phrase first at every word."""
    words = [w.rstrip(".'’-").replace("’", "'") or w for w in WORD.findall(title.lower())]
    out, i = [], 0
    while i < len(words):
        flat = words[i].replace("/", "").upper()
        if len(flat) == 6 and flat[:3] in CODES and flat[3:] in CODES and flat[:3] != flat[3:]:
            out.append(Unit("pair", (flat[:3], flat[3:])))
            i += 1
            continue
        for n in range(min(LONGEST, len(words) - i), 0, -1):
            found = PHRASES.get(tuple(words[i : i + n]))
            if found:
                out.append(found)
                i += n
                break
        else:
            out.append(Unit("word"))
            i += 1
    return out


JA_UNITS = sorted(
    [(n, Unit("currency" if n in JA_NAMES else "bank", (c,))) for c, names in JA_CURRENCY.items() for n in names.split("|")] + [(c, Unit(role)) for role, cues in JA_ROLES.items() for c in cues.split("|")],
    key=lambda x: -len(x[0]),
)
JA_FIND = regex.compile("|".join(regex.escape(n) for n, _ in JA_UNITS))
JA_OF = dict(reversed(JA_UNITS))
JA_PAIR = regex.compile(r"({0})[/・]?({0})".format("|".join(sorted(map(regex.escape, JA_NAMES - {"円相場"}), key=len, reverse=True))))


def units_ja(title: str) -> list[Unit]:
    """Units of a Japanese headline: two names together are a pair; letters between units are one word each three."""
    text, out, at = unicodedata.normalize("NFKC", title.replace("　", "、")), [], 0
    while at < len(text):
        pair = JA_PAIR.match(text, at)
        hit = JA_FIND.match(text, at)
        if pair and JA_OF[pair[1]].of != JA_OF[pair[2]].of:
            out.append(Unit("pair", (*JA_OF[pair[1]].of, *JA_OF[pair[2]].of)))
            at = pair.end()
        elif hit:
            out.append(JA_OF[hit[0]])
            at = hit.end()
        else:
            out += [Unit("word")] if at % 3 == 0 else []
            at += 1
    return out


def nearest(line: list[Unit], at: int) -> str | None:
    """The tracked currency named nearest to a place; none where another country's name is nearer. Ties: the one before."""
    named = [(abs(k - at), k > at, u) for k, u in enumerate(line) if u.role in ("currency", "bank", "elsewhere")]
    if not named:
        return None
    unit = min(named, key=lambda x: x[:2])[2]
    return unit.of[0] if unit.of else None


def subject(line: list[Unit], at: int, topic: bool) -> tuple[Unit, bool] | None:
    """The currency or pair that a move at ``at`` is told of, in its clause and within REACH, and whether it is denied.

    ``topic``: a comma right after a name marks it as what follows is about, as in Japanese.
    """
    denied = False
    for k in range(at - 1, max(at - REACH, 0) - 1, -1):
        role = line[k].role
        if role == "not":
            denied = True
        elif role in ("currency", "pair"):
            return line[k], denied
        elif role == "break" and topic and k and line[k - 1].role in ("currency", "pair"):
            continue
        elif role in ("elsewhere", "break", "up", "down"):
            return None
    return None


def read(title: str | None, japanese: bool) -> dict[str, float]:
    """Score of each currency that the headline speaks of, in -1..1; nothing said, nothing given."""
    if not title:
        return {}
    line = units_ja(title) if japanese else units(title)
    sums: dict[str, float] = {}
    moved = set()

    def add(code: str | None, value: float, own: bool = False) -> None:
        if code and value:
            sums[code] = sums.get(code, 0.0) + value
            if own:
                moved.add(code)

    for at, unit in enumerate(line):
        if unit.role in ("up", "down"):
            told = subject(line, at, japanese)
            if told is None or told[1]:
                continue
            sign = 1.0 if unit.role == "up" else -1.0
            add(told[0].of[0], sign, True)
            if told[0].role == "pair":
                add(told[0].of[1], -sign, True)
            elif not japanese:
                ahead = line[at + 1 : at + 1 + REACH]
                k = next((k for k, u in enumerate(ahead) if u.role == "against"), None)
                other = next((u for u in ahead[k + 1 : k + 4] if u.role in ("currency", "elsewhere")), None) if k is not None else None
                if other is not None and other.of and other.of != told[0].of:
                    add(other.of[0], -sign, True)
        elif unit.role in ("push_up", "push_down"):
            follow = next((u for u in line[at + 1 : at + 4] if u.role in ("currency", "elsewhere", "break")), None)
            if follow is not None and follow.of:
                add(follow.of[0], 1.0 if unit.role == "push_up" else -1.0, True)
    wish = [k for k, u in enumerate(line) if u.role == "wish"]
    for at, unit in enumerate(line):
        value = WEIGHT.get(unit.role)
        if value is None or (unit.role in ("hawk", "dove") and any(k < at for k in wish)):
            continue
        turned = any(u.role == "not" for u in line[max(at - 3, 0) : at]) or any(u.role in ("fade", "not") for u in line[at + 1 : at + 4]) or any(u.role == "fade" for u in line[max(at - 3, 0) : at])
        add(nearest(line, at), -value if turned and unit.role in ("hawk", "dove") else value)
    roles = {u.role for u in line}
    if "off" in roles or "on" in roles:
        for code, value in AVERSE.items():
            if code not in moved:
                add(code, value if "off" in roles else -value)
    if "intervene" in roles and "JPY" not in moved and any("JPY" in u.of for u in line):
        add("JPY", 0.8)
    return {c: round(math.tanh(v / 1.5), 3) for c, v in sorted(sums.items()) if abs(v) > 1e-9}


def scores(titles: DataFrame, ident: str, title: str) -> DataFrame:
    """ident, cur and score of each currency that a headline speaks of; titles with kana are read as Japanese.

    Equal titles are read once. A title that says nothing, a null and an empty one give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, said = [], []
            for text, ja in zip(batch.column("_t").to_pylist(), batch.column("_ja").to_pylist()):
                for cur, score in read(text, ja).items():
                    texts.append(text), said.append((cur, score))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([c for c, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], names=["_t", "cur", "score"])

    named = titles.where(F.length(title) > 0).select(ident, F.col(title).alias("_t"))
    each = named.select("_t").distinct().withColumn("_ja", F.col("_t").rlike(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"))
    return named.join(each.mapInArrow(run, "_t string, cur string, score double"), "_t").select(ident, "cur", "score")


def pair_signals(pressures: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pair and signal: pressure of the base less that of the quote, within -1..1; a currency without any has 0.

    ``pressures``: keys, cur, pressure; ``pairs``: pair, base, quote. Pairs of which neither has a pressure give no row.
    """
    sides = F.array(F.struct(F.col("base").alias("cur"), F.lit(1).alias("_s")), F.struct(F.col("quote").alias("cur"), F.lit(-1).alias("_s")))
    legs = pairs.select("pair", F.inline(sides))
    met = pressures.join(legs, "cur").groupBy(*keys, "pair").agg(F.sum(F.col("_s") * F.col("pressure")).alias("_v"))
    return met.select(*keys, "pair", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_v"))).alias("signal"))
