"""Texts as arrays: segments, tokens, hashed n-grams, length and title features of many documents at once."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

DIMS = 1 << 19  # hashed features; the weights are a vector of this length, whatever the corpus
SEP = "\x1e"
HIDDEN, BREAK, LINE, BLANK, LETTER, DIGIT, IDEO, SIGN = range(8)
_A, _B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
LONG = 120  # words from which a document is long
SPEAKS = 3.0  # value of a feature that stands for a group of words; an n-gram has 1

# words by what they stand for; a segment's groups and pairs of groups are features beside its n-grams
GROUPS = {
    "script": "javascript js script scripts scripting noscript cookie cookies browser blocker adblock スクリプト ブラウザ クッキー",
    "enable": "enable enabled allow allowed activate turn turned turning switch disabled support supported supports require requires required need necessary 有効 許可 オンに 必要 対応した 無効",
    "reader": "you your please sorry oops ください お使い ご利用 お手数 ご不便 お探し ご指定 申し訳",
    "again": "again reload refresh retry shortly later back moment 再度 再読み込み もう一度 しばらく お待ち",
    "fail": "error errors failed failure denied forbidden expired unavailable timeout exception traceback fatal warning invalid refused exceeded limited reset wrong missing unauthorized crashed unable cannot エラー 失敗 できません ありません 見つかりません 存在しません 拒否 切れました 発生しました 終了しました",
    "site": "page status site website server url uri link resource article request requests requested access connection database network gateway login upstream http html api permission ページ サイト サーバ サーバー 記事 セッション アクセス 接続 データベース ログイン",
    "filler": "lorem ipsum dolor amet consectetur placeholder placeholders dummy sample todo tbd tbc foo asdf qwerty untitled hello world post paragraph here サンプル ダミー 仮の テスト ここに 入力 例文",
    "human": "human robot bot captcha verify verification verifying checking traffic ロボット",
    "upkeep": "maintenance メンテナンス",
    "absent": "found gone located moved withdrawn deleted removed exist exists available find looking 移動 削除 存在",
    "named": "such stands template templates field fields marks marked named symbol symbols のような 記号 欄 示す 示し 示した",
    "report": "said saw called told wrote apologised shown displayed 表示 という との",
}
NAMES = list(GROUPS)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each character of the basic plane."""
    kind, low = np.full(1 << 16, SIGN, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        group = unicodedata.category(c)
        if c == SEP:
            kind[i] = BREAK
        elif c in "\n\r\x0b\x0c\x85  ":
            kind[i] = LINE
        elif c == "\t" or group == "Zs":
            kind[i] = BLANK
        elif group in ("Cf", "Cc", "Mn"):
            kind[i] = HIDDEN
        elif group == "Nd":
            kind[i] = DIGIT
        elif group[0] == "L":
            kind[i] = IDEO if 0x3040 <= i <= 0x30FF or 0x3400 <= i <= 0x9FFF else LETTER
        if group == "Lu" and len(c.lower()) == 1:
            low[i] = ord(c.lower())
    return kind, low


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        base, inverse = np.full(n, _A), np.full(n, np.uint64(pow(int(_A), -1, 1 << 64)))
        base[0] = inverse[0] = 1
        return np.cumprod(base), np.cumprod(inverse)


def spans(total: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of the stretches start..end of a text whose running sum of letter times power is ``total``."""
    return (total[end] - total[start]) * inverse[start]


def running(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(len(code)).bit_length())
    power, inverse = powers(size)
    return np.r_[np.uint64(0), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)])], inverse


def hashed(word: str) -> int:
    code = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
    total, _ = running(code)
    return int(total[-1])


@lru_cache(1)
def lexicon() -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Hashes of the groups' words that are tokens, their groups, and by length those that are stretches of letters."""
    words, stretches = {}, {}
    for g, name in enumerate(NAMES):
        for w in GROUPS[name].split():
            if w.isascii():
                words[hashed(w)] = g
            else:
                stretches.setdefault(len(w), {})[hashed(w)] = g
    sort = lambda d: (np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)]))
    return *sort(words), {n: sort(d) for n, d in stretches.items()}


def looked_up(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, value[at], -1)


@dataclass
class Pages:
    """Segments of many documents: features with values, owners, and what the weak labels look at."""

    texts: int
    owner: np.ndarray  # document of each segment
    index: np.ndarray  # features of all segments, segment after segment
    value: np.ndarray
    start: np.ndarray  # where each segment's features begin
    groups: np.ndarray  # segment x group
    signs: np.ndarray  # segments with a sign that prose doesn't use
    words: np.ndarray  # tokens that aren't signs or blanks
    again: np.ndarray  # share of the segment's document that is said more than twice
    turning: np.ndarray  # segments that go round in a few words
    status: np.ndarray  # segments that begin with a status or name one beside the word
    total: np.ndarray  # words of the segment's document
    quoted: np.ndarray
    runs: np.ndarray  # runs of four words, and their segments
    run_of: np.ndarray
    long: np.ndarray  # documents that are long and no filler
    cleaned: np.ndarray  # letters, for ``segment``
    first: np.ndarray
    last: np.ndarray

    def segment(self, k: int) -> str:
        return self.cleaned[self.first[k] : self.last[k]].tobytes().decode("utf-32-le", "replace").strip()


def runs_of(word: np.ndarray, seg: np.ndarray, run: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words within segments, and their segments."""
    if len(word) < run:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    key = word[: len(word) - run + 1].copy()
    for k in range(1, run):
        key = (key ^ (key >> np.uint64(15))) * _B + word[k : len(word) - run + 1 + k]
    same = seg[run - 1 :] == seg[: len(seg) - run + 1]
    return key[same], seg[: len(seg) - run + 1][same]


def shared(lot: list[Pages]) -> list[np.ndarray]:
    """Of each segment: the share of its runs of words that stand in a long document of another text of the lot too."""
    base = np.cumsum([0, *(p.texts for p in lot)])
    far = [p.long[p.owner[p.run_of]] if len(p.owner) else np.zeros(0, dtype=bool) for p in lot]
    keys = np.concatenate([p.runs[f] for p, f in zip(lot, far)])
    source = np.concatenate([p.owner[p.run_of[f]] + b for p, f, b in zip(lot, far, base)])
    known, first = np.unique(keys, return_index=True)
    source, out = source[first], []
    for p, b in zip(lot, base):
        if not len(known) or not len(p.owner):
            out.append(np.zeros(len(p.owner)))
            continue
        at = np.minimum(np.searchsorted(known, p.runs), len(known) - 1)
        seen = (known[at] == p.runs) & (source[at] != p.owner[p.run_of] + b)
        n = len(p.owner)
        out.append(np.bincount(p.run_of, weights=seen, minlength=n) / np.maximum(np.bincount(p.run_of, minlength=n), 1))
    return out


def bucket(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0) + 1.0) * 2, 31).astype(np.int64)


def slots(name: int, *parts: np.ndarray) -> np.ndarray:
    """Hashed places of whole-number features."""
    h = np.full(np.shape(parts[0]) if parts else (1,), name + 1, dtype=np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * _B
        h ^= h >> np.uint64(29)
    return ((h * _D) >> np.uint64(45)).astype(np.int32)


def paged(texts: list[str]) -> Pages:
    """All documents' segments and features; texts are whole, null is empty. Memory is in proportion to the texts."""
    kinds, lows = tables()
    joined = unicodedata.normalize("NFKC", SEP.join(t.replace(SEP, " ") for t in texts) + SEP)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.where(code < 1 << 16, kinds[np.minimum(code, 0xFFFF)], np.where((code >= 0x20000) & (code < 0x32000), IDEO, SIGN)).astype(np.uint8)
    code, kind = code[kind != HIDDEN], kind[kind != HIDDEN]
    n = len(code)
    low = np.where(code < 1 << 16, lows[np.minimum(code, 0xFFFF)], code)
    nxt = np.r_[kind[1:], BREAK]
    stop = (code == 0x2E) | (code == 0x21) | (code == 0x3F)
    ends = (kind == BREAK) | (kind == LINE) | (stop & ((nxt == BLANK) | (nxt == LINE) | (nxt == BREAK))) | (code == 0x3002)
    part = np.r_[0, np.cumsum(ends)[:-1]]
    document = np.r_[0, np.cumsum(kind == BREAK)[:-1]]
    solid = (kind >= BLANK)
    head = np.r_[True, (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])] | (kind == IDEO) | (kind == SIGN)
    begin = np.flatnonzero(head)
    end = np.r_[begin[1:], n]
    keep = solid[begin]
    begin, end = begin[keep], end[keep]
    tk, seg = kind[begin], part[begin]
    # segments that hold a word or sign, numbered anew
    held = np.zeros(int(part[-1]) + 1 if n else 1, dtype=bool)
    held[seg[tk > BLANK]] = True
    number = np.cumsum(held) - 1
    inside = held[seg]
    begin, end, tk, seg = begin[inside], end[inside], tk[inside], number[seg[inside]]
    count = int(held.sum())
    empty = np.zeros(0, dtype=np.int64)
    if not count:
        none = np.zeros(0, dtype=bool)
        return Pages(len(texts), empty, empty.astype(np.int32), empty.astype(np.float32), empty, np.zeros((0, len(NAMES)), dtype=bool), none, empty, np.zeros(0), none, none, empty, none, empty.astype(np.uint64), empty, np.zeros(len(texts), dtype=bool), code, empty, empty)
    with np.errstate(over="ignore"):
        return _features(len(texts), code, low, kind, document, begin, end, tk, seg, count)


def _features(texts: int, code, low, kind, document, begin, end, tk, seg, count) -> Pages:
    lead = np.searchsorted(seg, np.arange(count))
    owner = document[begin[lead]]
    total, inverse = running(low)
    word = spans(total, begin, end, inverse)
    size = end - begin
    word[tk == DIGIT] = _C
    real = tk > BLANK
    wordy = (tk == LETTER) | (tk == DIGIT) | (tk == IDEO)
    words = np.bincount(seg[wordy], minlength=count)
    mark = np.cumsum(np.isin(low[begin], np.frombuffer("\"“”「」『』".encode("utf-32-le"), dtype=np.uint32)) & (tk == SIGN))
    within = (mark - (mark[lead] - np.isin(low[begin[lead]], np.frombuffer("\"“「『".encode("utf-32-le"), dtype=np.uint32)))[seg]) % 2 == 1
    # shapes: kind and case; a sign is itself
    upper = np.r_[0, np.cumsum(low != code)]
    capitals = upper[end] - upper[begin]
    shape = np.where(tk == SIGN, word, np.where(tk == LETTER, np.where(size == 1, 11, np.where(capitals == size, 12, np.where(capitals > 0, 13, 14))), tk).astype(np.uint64))
    rare = (tk == SIGN) & ~np.isin(low[begin], np.frombuffer(".,;:'\"()/-+%、。「」・()".encode("utf-32-le"), dtype=np.uint32))
    index, value, of = [], [], []

    def put(feature: np.ndarray, owners: np.ndarray, weight: float | np.ndarray = 1.0) -> None:
        index.append(feature.astype(np.int32)), of.append(owners), value.append(np.broadcast_to(np.float32(weight), len(owners)))

    def grams(one: np.ndarray, owners: np.ndarray, longest: int, least: int, salt: np.uint64, marked: np.ndarray | None, weight: np.ndarray) -> None:
        mixed, any_ = one * salt, marked
        for k in range(1, longest + 1):
            if k > 1:
                if len(one) < k:
                    return
                mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(15))) * _B + one[k - 1 :]
                any_ = any_[:-1] | marked[k - 1 :] if marked is not None else None
            if k >= least:
                same = owners[k - 1 :] == owners[: len(owners) - k + 1]
                same = same & any_ if marked is not None else same
                put((((mixed[same] ^ (mixed[same] >> np.uint64(31))) * _D) >> np.uint64(45)).astype(np.int32), owners[k - 1 :][same], weight[owners[k - 1 :][same]])

    damp = np.minimum(1.0, np.sqrt(8.0 / np.maximum(words, 1))).astype(np.float32)  # a long sentence says no more by its words
    grams(word[real], seg[real], 3, 1, _A, None, damp)
    grams(shape, seg, 5, 3, _C, rare, np.full(count, 2.0, dtype=np.float32))
    # groups of words
    known, group, stretches = lexicon()
    groups = np.zeros((count, len(NAMES)), dtype=bool)
    hit = looked_up(word, known, group)
    at = np.flatnonzero((hit >= 0) & (tk == LETTER))
    quoted = np.zeros(count, dtype=bool)
    quoted[seg[at[within[at]]]] = True
    at = at[~within[at]]
    groups[seg[at], hit[at]] = True
    place = np.flatnonzero(kind == IDEO)
    seg_of = np.searchsorted(begin, place, side="right") - 1
    for n, (h, g) in stretches.items():
        fits = place + n <= len(code)
        found = looked_up(spans(total, place[fits], place[fits] + n, inverse), h, g)
        at = np.flatnonzero(found >= 0)
        of_at = seg_of[fits][at]
        quoted[seg[of_at[within[of_at]]]] = True
        groups[seg[of_at[~within[of_at]]], found[at[~within[of_at]]]] = True
    digits = (tk == DIGIT) & (size == 3) & ((low[begin] == 0x34) | (low[begin] == 0x35))
    position = np.arange(len(begin)) - lead[seg]
    status = np.zeros(count, dtype=bool)
    fail, site, absent = (groups[:, NAMES.index(x)] for x in ("fail", "site", "absent"))
    coded = np.zeros(count, dtype=bool)
    coded[seg[digits]] = True
    opens = np.zeros(count, dtype=bool)
    opens[seg[digits & (position <= 4)]] = True
    status = (coded & (fail | (site & (words <= 6)))) | (opens & absent & (words <= 8)) | (opens & (words <= 4) & fail)
    # what is said again in the document, and segments that go round in few words
    said = np.zeros(count, dtype=np.uint64)
    np.add.at(said, seg[real], (word[real] ^ (position[real].astype(np.uint64) * _B)) * _D)
    key = said ^ (owner.astype(np.uint64) * _C)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    of_doc = np.bincount(owner, weights=words, minlength=texts)
    more = np.bincount(owner, weights=words * ((times[back] >= 3) & (words > 1)), minlength=texts)
    again = (more / np.maximum(of_doc, 1))[owner]
    pair = (word[wordy] * _B) ^ (seg[wordy].astype(np.uint64) * _C)
    own = seg[wordy]
    _, where = np.unique(pair, return_index=True)
    kinds_of = np.bincount(own[where], minlength=count)
    ideo = np.bincount(seg[tk == IDEO], minlength=count)
    letters = np.bincount(seg[tk == LETTER], minlength=count)
    turning = ((letters >= 6) & (2 * letters >= words) & (3 * kinds_of <= words) & (ideo == 0)) | ((ideo >= 16) & (4 * kinds_of <= words))
    distinct = bucket(8.0 * words / np.maximum(kinds_of, 1))
    round_ = np.bincount(owner, weights=words * turning, minlength=texts)
    long = (of_doc > LONG) & (2 * more < of_doc) & (4 * round_ < of_doc)
    # length, title and place in the document
    parts = np.bincount(owner, minlength=texts)[owner]
    first_of = np.r_[True, owner[1:] != owner[:-1]]
    last_of = np.r_[owner[1:] != owner[:-1], True]
    place_of = first_of + 2 * last_of
    everyone = np.arange(count)
    whole = of_doc[owner].astype(np.int64)
    brief = whole <= 90
    put(slots(1, bucket(words)), everyone)
    put(slots(2, bucket(whole)), everyone)
    put(slots(3, np.minimum(parts, 12), place_of), everyone)
    put(slots(4, (again * 8).astype(np.int64)), everyone, SPEAKS)
    put(slots(5, distinct, brief), everyone)
    put(slots(6, turning), everyone, SPEAKS)
    put(slots(7, status, brief), everyone, SPEAKS)
    put(slots(8, quoted, coded), everyone)
    title = groups[np.flatnonzero(first_of)]
    rank = np.cumsum(first_of) - 1
    for a in range(len(NAMES)):
        at = np.flatnonzero(groups[:, a])
        put(slots(9, at * 0 + a, brief[at]), at, SPEAKS)
        at = np.flatnonzero(title[rank, a] & ~first_of)
        put(slots(10, at * 0 + a), at)
        for b in range(a):
            at = np.flatnonzero(groups[:, a] & groups[:, b])
            if len(at):
                put(slots(11, at * 0 + a * 64 + b, brief[at]), at, SPEAKS)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    signs = np.zeros(count, dtype=bool)
    signs[seg[(tk == SIGN) & (rare | (low[begin] == 0x25) | (low[begin] == 0x28))]] = True
    last = np.r_[lead[1:], len(begin)] - 1
    return Pages(texts, owner, np.concatenate(index)[order], np.concatenate(value)[order], np.searchsorted(of[order], everyone), groups, signs, words, again, turning, status, whole, quoted, *runs_of(word[wordy], own), long, code, begin[lead], end[last])
