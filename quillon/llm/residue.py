"""Problem 8: template residue, filler, error pages and script notices, by a linear classifier on hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from http import HTTPStatus

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quillon.llm.byte_bpe import slices
from quillon.llm.residue_text import DIMS, NAMES, Pages, paged, shared

SAMPLE = 16_000  # labelled documents that the classifier is fitted on at most
SAMPLE_CHARS = 20_000  # longer documents are not drawn for the sample (they are scored whole)
HELD_OUT = 5  # one publisher in so many is kept for validation and for the choice of the threshold
PLANTED = 4_000  # genuine sentences of the sample that a place is planted into
BRIEF = 120  # words of a document that may be a page or notice as a whole

# --- weak labels ------------------------------------------------------------------------------------------------

NAME = r"[\p{L}_][\p{L}\p{N}_ .:-]{0,30}"
# forms of an unfilled place or a failed fill: marks around a name, runs of a filling sign, names of missing values
FORMS = regex.compile("|".join([
    rf"\{{\{{+ ?{NAME} ?\}}\}}+", rf"\{{% ?{NAME} ?%\}}", rf"<%=? ?{NAME} ?%>", rf"[$#%]\{{{NAME}\}}", r"(?<![\w\"])\{[\p{L}_\d][\p{L}\p{N}_]*\}", rf"<<{NAME}>>", r"<(?!(?i:b|i|p|br|em|hr|ul|ol|li|strong|code|message|error|requestid|html|head|body|title|div|span|pre|table|tr|td)>)\p{L}[\p{L}_]+>", rf"%\({NAME}\)s",
    r"%[\p{Lu}_]{3,}%", rf"\[\[{NAME}\]\]", r"\[\p{Lu}[\p{Lu}_\d]{3,}\]", r"\[(?i:insert|tbc|tbd|todo|your|enter)\b[^\]\n]{0,40}\]", r"\[[\p{Han}\p{Hiragana}\p{Katakana}]{2,8}\]", r"__\p{L}[\p{L}\p{N}_]*?__", r"(?<!_)_{4,8}(?!_)",
    rf"@@?{NAME}@@?(?![\w.])", r"\$\p{L}[\p{L}_]{2,}\$?", r"(?<=\S)【[^】\n]{2,12}】", r"\([\p{L}_ ]{1,20}を入力\)", rf"※{NAME}※", r"●●+", r"○○+|〇〇+", r"××+", r"\b[Xx]{4}\b", r"\b(?i:undefined|nan|null) (?i:in|of|than|for|at|and|on)\b", r"\[(?i:object object)\]",
]))
PAYLOAD = regex.compile(r"^\s*[{<].{0,60}error", regex.I)  # a machine's answer and nothing else
RECORD = regex.compile(r'^\s*\{\s*"type"\s*:')  # a ledger line, whatever errors it records


def group(pages: Pages, name: str) -> np.ndarray:
    return pages.groups[:, NAMES.index(name)]


def labels(pages: Pages, shared: np.ndarray) -> np.ndarray:
    """Weak labels of segments: 1 residue, 0 none, -1 not said.

    Phrases and statuses count where they make a good part of a brief document, for a page is its whole document; in a
    longer text they are a mention, and what long texts say (``shared``) is one in a brief text too. Filler is what a document says over and over or is made of for the most part.
    Places count wherever they stand but where the words or quotation marks around them show that they are named.
    """
    if not len(pages.owner):
        return np.zeros(0, dtype=np.int8)
    of = {name: group(pages, name) for name in NAMES}
    total = lambda flag: np.bincount(pages.owner, weights=pages.words * flag, minlength=pages.texts)
    part = lambda flag: (total(flag) / np.maximum(total(np.ones(len(flag))), 1))[pages.owner]
    brief = pages.total <= BRIEF
    filler = pages.turning | (pages.again >= 0.5) | (of["filler"] & (part(of["filler"]) >= 0.3) & (shared < 0.25))
    alone = phrases(of) | pages.status | (brief & phrases({name: total(flag)[pages.owner] > 0 for name, flag in of.items()}) & (of["fail"] | of["site"] | of["human"] | of["script"] | of["upkeep"]))
    alone &= ~(of["report"] | of["named"])
    form, payload, record = (np.zeros(len(filler), dtype=bool) for _ in range(3))
    for k in range(len(filler)):
        text = pages.segment(k)
        form[k] = FORMS.search(text) is not None
        if pages.signs[k]:
            record[k], payload[k] = RECORD.match(text) is not None, PAYLOAD.match(text) is not None
    # what long texts say among other things is a mention in a brief one too
    page = ((alone & ~pages.quoted & (part(alone) >= 0.12)) | payload) & brief & (shared < 0.25)
    yes = ((form & ~of["named"] & ~pages.quoted) | page | filler) & ~record
    residue = np.zeros(pages.texts, dtype=bool)
    residue[pages.owner[page | filler]] = True
    hint = (shared < 0.25) & (of["script"] | of["fail"] | of["site"] | of["reader"] | of["filler"]) & brief
    return np.where(yes, 1, np.where((residue[pages.owner] | hint) & ~record, -1, 0)).astype(np.int8)


def phrases(of: dict[str, np.ndarray]) -> np.ndarray:
    """Groups of words that together are said by pages and notices."""
    reader, fail, site, script = of["reader"], of["fail"], of["site"], of["script"]
    gone = site & of["absent"]
    return (script & (of["enable"] | reader)) | (reader & (fail | gone)) | (site & fail) | gone | (script & of["absent"]) | (script & fail) | (of["human"] & (reader | script | site)) | (of["upkeep"] & (reader | of["again"])) | (fail & of["again"])


# --- made examples ----------------------------------------------------------------------------------------------

AROUND = [("{{", "}}"), ("{{ ", " }}"), ("{{{", "}}}"), ("{% ", " %}"), ("<%= ", " %>"), ("${", "}"), ("#{", "}"), ("{", "}"), ("<<", ">>"), ("<", ">"), ("%(", ")s"), ("%", "%"), ("[[", "]]"), ("[", "]"), ("__", "__"), ("@@", "@@"), ("[insert ", "]"), ("[TBC: ", "]"), ("※", "※"), ("【", "】"), ("$", "$"), ("@", "@")]
BARE = ["____", "○○○", "●●", "××", "XXXX", "undefined", "[object Object]", "NaN", "null", "〇〇"]
JOINS = ["_", "", ".", "-", " "]
ASKS = [("Please ", "enable", " {} to continue."), ("You need to ", "turn on", " {} to view this site."), ("This page requires {}.", "", ""), ("{} is disabled in your browser.", "", ""), ("Your browser does not support {}.", "", ""), ("", "Allow", " {} and reload the page."), ("", "Activate", " {} in your browser, then try again."), ("This application does not work without {}.", "", "")]
THINGS = ["JavaScript", "scripts", "cookies", "JavaScript and cookies", "scripting"]
ASKS_JA = ["{}を有効にしてください。", "{}をオンにしてください。", "このサイトの閲覧には{}が必要です。", "{}が無効になっています。", "{}を許可して再読み込みしてください。"]
THINGS_JA = ["JavaScript", "スクリプト", "Cookie", "ブラウザのJavaScript"]
SUBJECTS = ["The page", "This file", "The requested article", "Your session", "The service", "The server", "The video", "Your login"]
FAULTS = ["could not be found", "has expired", "is temporarily unavailable", "has timed out", "is overloaded", "cannot be displayed", "failed with an exception", "is missing"]
SUBJECTS_JA = ["ページ", "記事", "サーバー", "接続", "サービス", "ファイル"]
FAULTS_JA = ["が見つかりません。", "を表示できません。", "は現在利用できません。", "が混み合っています。時間をおいてお試しください。", "でエラーが発生しました。", "がタイムアウトしました。"]
FILLERS = ["Sample text only.", "Replace this text before release.", "Placeholder paragraph.", "Insert your content here.", "Dummy text for layout.", "Text to be written.", "Draft text, content to follow.", "サンプルテキスト。", "ダミーの文章です。", "本文が入ります。"]
TITLES = ["", "", "", "Market wrap\n\n", "GBP update\n\n", "市況\n\n"]


def planted(sentence: str, place: str, rng: np.random.Generator) -> str:
    """The sentence with a place for one of its words, or for a few letters where no blanks part words."""
    words = sentence.split(" ")
    if len(words) > 2:
        words[int(rng.integers(len(words)))] = place
        return " ".join(words)
    at = int(rng.integers(max(len(sentence) - 3, 1)))
    return sentence[:at] + place + sentence[at + int(rng.integers(1, 5)) :]


def made(genuine: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Documents whose labels are known by how they were made, so that the forms count and not the words around.

    Genuine sentences with one word in marks of a place (1) or merely with a quoted phrase (0); pages of the standard
    response statuses, notices and filler (1).
    """
    texts, label = [], []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    for sentence in genuine:
        a, z = pick(AROUND)
        words = [w for w in regex.findall(r"[a-zA-Z]{3,}|[\p{Han}\p{Katakana}]{2,4}", pick(genuine)[:200]) if w] or ["name"]
        name = pick(JOINS).join(pick(words) for _ in range(int(rng.integers(1, 3))))
        name = pick([str.lower, str.lower, str.upper, str])(name)[:24]
        if a == "{" and rng.random() < 0.3:
            name = str(rng.integers(0, 10))
        elif a in ("<", "[", "$", "@") and name.isascii():
            name = name + pick(["_name", "_price", "_" + name[:4]]) if len(name) < 5 else name
            name = name.upper() if a == "[" else name.replace(" ", "_")
        if rng.random() < 0.15 and len(name) > 2:
            name += str(rng.integers(0, 10))
        place = pick(BARE) if rng.random() < 0.35 else f"{a}{name}{z}"
        texts += [planted(sentence, place, rng), sentence]
        label += [1, 0]
        cut = sorted(rng.integers(0, len(sentence) + 1, 2).tolist())
        if cut[1] - cut[0] > 1:
            texts.append(sentence[cut[0] : cut[1]]), label.append(0)
    pages = []
    for status in HTTPStatus:
        if status >= 400:
            code, phrase = status.value, status.phrase
            pages += [f"{code} {phrase}", f"HTTP {code} {phrase}", f"Error {code}", f"{code} {phrase}\n\n{status.description or phrase}.", f"HTTP Error {code}: {phrase}"]
            pages += [f'{{"error": {{"code": {code}, "message": "{phrase.lower()}"}}}}', f"<error><code>{code}</code><message>{phrase}</message></error>"]
            for sentence in (pick(genuine), pick(genuine)) if genuine else ():
                texts.append(f'{sentence} The page said "{pick([str(code), phrase])}" for a while.'), label.append(0)
    pages += [a.replace("{}", t) + b + c.replace("{}", t) for a, b, c in ASKS for t in THINGS] + [a.replace("{}", t) for a in ASKS_JA for t in THINGS_JA] + [f"{a} {b}." for a in SUBJECTS for b in FAULTS] + [a + b for a in SUBJECTS_JA for b in FAULTS_JA] + FILLERS * 3
    titles = [pick(TITLES) for _ in pages]
    titled = np.r_[np.zeros(len(texts), dtype=bool), np.array([t != "" for t in titles], dtype=bool)]
    return texts + [t + p for t, p in zip(titles, pages)], np.r_[np.array(label, dtype=np.int8), np.ones(len(pages), dtype=np.int8)], titled


# --- classifier -------------------------------------------------------------------------------------------------


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def logit(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[index] * value, start) + self.bias if len(start) else np.zeros(0)

    def probability(self, pages: Pages) -> np.ndarray:
        """Of each document: the greatest probability of its segments."""
        p = np.zeros(pages.texts)
        if len(pages.owner):
            np.maximum.at(p, pages.owner, 1.0 / (1.0 + np.exp(-np.clip(self.logit(pages.index, pages.value, pages.start), -60, 60))))
        return p


@dataclass
class Cases:
    """Labelled segments: features, values, begins, labels, whether the publisher is held out, and documents."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray
    label: np.ndarray
    held: np.ndarray

    def chosen(self, rows: np.ndarray) -> "Cases":
        length = np.diff(np.r_[self.start, len(self.index)])
        taken = np.repeat(self.start[rows], length[rows]) + within(length[rows])
        return Cases(self.index[taken], self.value[taken], np.r_[0, np.cumsum(length[rows])[:-1]].astype(np.int64), self.label[rows], self.held[rows])


def within(length: np.ndarray) -> np.ndarray:
    return np.arange(int(length.sum())) - np.repeat(np.r_[0, np.cumsum(length)[:-1]].astype(np.int64), length) if len(length) else np.zeros(0, dtype=np.int64)


def fit(cases: Cases, epochs: int = 12, batch: int = 4096, decay: float = 2e-5, rate: float = 0.05, seed: int = 3) -> Classifier:
    """Logistic regression with an L2 penalty by mini-batch Adam; either class has half of the weight."""
    n, positive = len(cases.label), max(int(cases.label.sum()), 1)
    balance = np.where(cases.label == 1, 0.5 * n / positive, 0.5 * n / max(n - positive, 1))
    w, m, v = np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS)
    b = mb = vb = 0.0
    rng, t = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            rows = np.sort(order[a : a + batch])
            part = cases.chosen(rows)
            length = np.diff(np.r_[part.start, len(part.index)])
            z = np.add.reduceat(w[part.index] * part.value, part.start) + b
            g = (1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - part.label) * balance[rows] / len(rows)
            gw = np.bincount(part.index, weights=np.repeat(g, length) * part.value, minlength=DIMS) + decay * w
            t += 1
            gb, step = float(g.sum()), rate * (1 - epoch / epochs)
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return Classifier(w.astype(np.float32), b)


def together(cases: list[Cases]) -> Cases:
    base = np.cumsum([0, *(len(c.index) for c in cases)])
    begins = np.concatenate([c.start + b for c, b in zip(cases, base)])
    return Cases(*(np.concatenate([getattr(c, f) for c in cases]) for f in ("index", "value")), begins, *(np.concatenate([getattr(c, f) for c in cases]) for f in ("label", "held")))


def in_pieces(texts: list[str], piece: int = 1_000) -> list[Pages]:
    """Pages of many texts, made a piece at a time: little more than the result is held."""
    return [paged(texts[a : a + piece]) for a in range(0, max(len(texts), 1), piece)]


@dataclass
class Lot:
    """The labelled sample: pages, their segments' labels and which documents' publishers are held out."""

    pages: list[Pages]
    labels: list[np.ndarray]
    held: list[np.ndarray]


def lot_of(sample: pd.DataFrame) -> Lot:
    texts = sample["text"].fillna("").tolist()
    host = sample["publisher"].fillna("").map(lambda h: zlib.crc32(h.encode("utf-8", "surrogatepass")) % HELD_OUT == 0).to_numpy(dtype=bool)
    pages = in_pieces(texts)
    ends = np.cumsum([0, *(p.texts for p in pages)])
    return Lot(pages, [labels(p, s) for p, s in zip(pages, shared(pages))], [host[a:z] for a, z in zip(ends, ends[1:])])


def cases_of(lot: Lot, all_hosts: bool) -> Cases:
    """Labelled segments (of the hosts that aren't held out, or of all) and made ones.

    Of the segments without residue, four tenths of those without signs or words of a group do.
    """
    rng = np.random.default_rng(11)
    found, genuine = [], []
    for pages, said, held in zip(lot.pages, lot.labels, lot.held):
        if not len(said):
            continue
        seen = all_hosts | ~held[pages.owner]
        dull = (said == 0) & ~pages.groups.any(axis=1) & ~pages.signs & ~pages.quoted
        rows = np.flatnonzero(seen & ((said == 1) | ((said == 0) & (~dull | (rng.random(len(said)) < 0.4)))))
        found.append(Cases(pages.index, pages.value, pages.start, said, held[pages.owner]).chosen(rows))
        plain = np.flatnonzero(dull & seen)
        genuine += [pages.segment(k) for k in rng.permutation(plain)[: -(-PLANTED // len(lot.pages))]]
    extra, label, titled = made(genuine, rng)
    more = paged(extra)
    known = label[more.owner]
    keep = np.flatnonzero(~(titled[more.owner] & np.r_[True, more.owner[1:] != more.owner[:-1]]))  # a page without its title
    return together([*found, Cases(more.index, more.value, more.start, known, np.zeros(len(known), dtype=bool)).chosen(keep)])


def judged(lot: Lot, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Weak label and probability of each held-out document of which something is said."""
    want, got = [], []
    for pages, said, held in zip(lot.pages, lot.labels, lot.held):
        yes, open_ = np.zeros(pages.texts, dtype=bool), np.zeros(pages.texts, dtype=bool)
        if len(said):
            yes[pages.owner[said == 1]] = True
            open_[pages.owner[said == -1]] = True
        told = held & (yes | ~open_)
        want.append(yes[told]), got.append(model.probability(pages)[told])
    return (np.concatenate(want), np.concatenate(got)) if want else (np.zeros(0, dtype=bool), np.zeros(0))


LEVELS = np.round(np.arange(0.3, 0.96, 0.05), 2)


def trained(lot: Lot) -> tuple[Classifier, tuple[int, int, int, int]]:
    """The classifier and its figures on unseen publishers: documents, positive, found, both.

    It is fitted without the held-out publishers first; the threshold is a low one of the levels that come within half
    a hundredth of the best F1 on those. Then it is fitted on all.
    """
    want, got = judged(lot, fit(cases_of(lot, False)))
    score = np.array([2 * (want & (got >= t)).sum() / max(want.sum() + (got >= t).sum(), 1) for t in LEVELS])
    good = LEVELS[score >= score.max() - 0.005]
    threshold = float(good[len(good) // 3]) if want.any() else 0.6
    model = fit(cases_of(lot, True))
    model.threshold = threshold
    hit = got >= threshold
    return model, (len(want), int(want.sum()), int(hit.sum()), int((want & hit).sum()))


# --- over the corpus --------------------------------------------------------------------------------------------


def drawn(documents: DataFrame) -> pd.DataFrame:
    """The bounded sample: at most SAMPLE documents, chosen by a hash of text and id, with their publishers."""
    usable = documents.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    total = documents.count()
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    chosen = usable.where(lot < int(min(1.0, 1.1 * SAMPLE / max(total, 1)) * 1_000_000))
    return chosen.select("text", "publisher").limit(SAMPLE).toPandas()


def scored(batches: Iterator[pa.RecordBatch], model: Classifier, chars: int = 500_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in slices(batch.column("text"), chars):
            p = model.probability(paged([t or "" for t in batch.column("text").slice(a, z - a).to_pylist()]))
            rest = [batch.column(c).slice(a, z - a) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p), pa.array(p >= model.threshold)], names=[*(c for c in batch.schema.names if c != "text"), "score", "residue"])


def residue(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``score`` and ``residue`` of each document.

    ``score`` is the greatest probability that the classifier gives any line or sentence of the document, from its
    hashed n-grams, its length, the document's length, title and place; ``residue`` says that it reaches the threshold.
    Nothing else decides: no list of phrases is looked at when documents are scored.

    The classifier is fitted on the driver on a bounded sample (SAMPLE documents) with weak labels and made examples
    (see ``labels`` and ``made``); its weights have a fixed size. One publisher in HELD_OUT chooses the threshold and
    gives the figures of ``validation``. Every document is then scored whole, where it lies: nothing is shuffled.
    Null, empty and blank texts have score 0 and no residue; repeated rows each come out.
    """
    model, _ = trained(lot_of(drawn(documents)))
    kept = documents.select(*keep, F.col("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("text").schema.fields)
    return kept.mapInArrow(lambda batches: scored(batches, model), f"{fields}, score double, residue boolean")


def validation(documents: DataFrame) -> DataFrame:
    """Figures on documents of the publishers that the classifier hasn't seen: documents, positive, found, both, threshold."""
    model, figures = trained(lot_of(drawn(documents)))
    return documents.sparkSession.createDataFrame([(*figures, model.threshold)], "documents bigint, positive bigint, found bigint, both bigint, threshold double")
