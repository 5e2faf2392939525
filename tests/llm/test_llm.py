"""Problems 4, 6, 7 and 8: brute force, public libraries, held-out figures, edge cases."""

import datetime as dt
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import DATA, connection, same  # noqa: E402

from quillon.llm import byte_bpe as B, mixing as M, nearest_time as N, queries as Q, residue as R, residue_text as T  # noqa: E402

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_rows_of_sql(name, spark):
    same(Q.QUERIES[name], Q.ORACLE[name], spark, connection())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_runs(name, spark):
    df = Q.QUERIES[name](spark, DATA)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


# --- problem 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2**N.BITS - 1)), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**N.BITS - 1)), min_size=1, max_size=40))
def test_trie_finds_both_neighbours(keys, asks):
    keys = sorted(set(keys))
    entity, key = (np.array(x, dtype=np.int64) for x in zip(*keys))
    asks += [(e, k) for e, k in keys[:3]] + [(e, min(k + 1, 2**N.BITS - 1)) for e, k in keys[:3]]
    who, what = (np.array(x, dtype=np.int64) for x in zip(*asks))
    before, after = N.Tries(entity, key).around(who, what)
    for i, (e, x) in enumerate(asks):
        own = [k for f, k in keys if f == e]
        low, high = [k for k in own if k <= x], [k for k in own if k > x]
        assert (keys[before[i]] if before[i] >= 0 else None) == ((e, max(low)) if low else None)
        assert (keys[after[i]] if after[i] >= 0 else None) == ((e, min(high)) if high else None)


def test_nearest_bars_equal_brute_force(spark):
    rng = random.Random(6)
    spell = lambda: rng.choice(["EURUSD", "eur/usd", "EUR_USD"])
    border = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=N.BLOCK_US * 1551)
    bars = [(i, rng.choice("ab"), spell(), rng.choice(["15m", "1h", "1d"]), rng.choice([T0, border]) + dt.timedelta(minutes=15 * rng.randrange(-300, 300)), rng.choice([1.0, 1.0, None]), "x", "x") for i in range(900)]
    asks = [(i, rng.choice("abc"), spell(), rng.choice(["15m", "1h", "1d"]), rng.choice([T0, border]) + dt.timedelta(seconds=rng.randrange(-270_000, 270_000, 450)), None, "x", "x") for i in range(500)]
    asks += [(900 + i, *a[1:]) for i, a in enumerate(asks[:50])] + [(2000, "a", "EURUSD", "1h", None, 1.0, "x", "x")]
    minutes = {"15m": 15, "1h": 60, "1d": 0}
    want = {}
    for q, root, _, tf, at, *_ in asks:
        near = [(abs(b[4] - at), b[4], b[0]) for b in bars if at is not None and minutes[tf] and b[1] == root and b[3] == tf and b[5] is not None and abs(b[4] - at) <= dt.timedelta(minutes=minutes[tf])]
        if near:
            want[q] = min(near)[2]
    p = spark.createDataFrame(bars, "line_id long, root string, pair string, tf string, bar_time timestamp_ntz, close double, id string, at string")
    q = spark.createDataFrame(asks, "quote_id long, root string, pair string, tf string, quote_time timestamp_ntz, price double, block string, tolerance string")
    f = spark.createDataFrame(list(minutes.items()), "tf string, minutes int")
    got = {r.quote_id: r.line_id for r in N.quotes_at_bars(q, p, f).collect()}
    assert got == want and want
    assert N.quotes_at_bars(q.limit(0), p, f).count() == 0 and N.quotes_at_bars(q, p.limit(0), f).count() == 0


# --- problem 6

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(B.VOCABULARY)
    t.encode_special_tokens = True
    return t


HARD = ["", None, " ", "a" * 3000, "aaaa aaa aa", "\n\n \t x", "<|endoftext|>!", "don't we'll I'M", "　日本語のテキスト。" * 40, "😀👍🏽", "\x00\x85 ​", "１２３．４５ ½ fi", "x" + " " * 300 + "y"]


def test_ids_equal_the_public_library(spark, public):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD * 2)] + [(None, "null id", "x")], "doc_id long, text string, words string")
    got = {r.doc_id: list(r.ids) for r in B.token_ids(docs, ["doc_id"]).collect()}
    assert got.pop(None) == public.encode("null id", add_special_tokens=False).ids
    assert got == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(HARD * 2)}
    assert B.token_ids(docs.limit(0), ["doc_id"]).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_ids_of_any_text_and_back(public, texts):
    global ENCODER
    ENCODER = globals().get("ENCODER") or B.Encoder(B.VOCABULARY)
    ids, start = ENCODER.encode(texts)
    for i, t in enumerate(texts):
        own = ids[start[i] : start[i + 1]].tolist()
        assert own == public.encode(t, add_special_tokens=False).ids
        assert public.decode(own, skip_special_tokens=False) == t


def test_slices_and_forgetting_change_nothing():
    texts = [f"word{i} and 東京{i} " * (i % 7) for i in range(60)]
    one, small = B.Encoder(B.VOCABULARY), B.Encoder(B.VOCABULARY, remember=20)
    whole, start = one.encode(texts)
    parts = [small.encode(texts[a:z])[0] for a, z in B.slices(pa.array(texts), 100)]
    assert np.concatenate(parts).tolist() == whole.tolist() and start[-1] == len(whole)


# --- problem 7


def test_shortages_go_to_siblings_first():
    root = M.Node(children={"wire": M.Node(children={"en": M.Node(1, 10), "ja": M.Node(1, 100)}), "desk": M.Node(children={"any": M.Node(2, 100)})})
    root.gather()
    root.spend(80)
    leaf = {k: g.budget for d in root.children.values() for k, g in d.children.items()}
    assert leaf == {"en": 10, "ja": 30, "any": 40}
    root.spend(200)
    assert sum(g.budget for d in root.children.values() for g in d.children.values()) == 200
    root.spend(1000)
    assert root.budget == 210


def test_a_leaf_without_weight_gives_no_capacity():
    leaf = lambda w, c: M.Node(w, c)
    root = M.Node(children={"a": M.Node(children={"en": leaf(1, 10), "ja": leaf(0, 1000)}), "b": M.Node(children={"en": leaf(1, 500)})})
    root.gather()
    root.divide(M.Fraction(200))
    root.spend(200)
    got = {(d, g): n for d, x in root.children.items() for g, n in x.children.items()}
    assert {k: n.budget for k, n in got.items()} == {("a", "en"): 10, ("a", "ja"): 0, ("b", "en"): 190}
    assert {k: n.due for k, n in got.items()} == {("a", "en"): 100, ("a", "ja"): 0, ("b", "en"): 100}
    assert [k for k, n in got.items() if n.short()] == [("a", "en")] and root.children["a"].short()


def test_short_is_exact_at_the_border(spark):
    """Three equal weights of a total that doesn't divide: a capacity of a third less one is short, of a third is not."""
    rows = [(1, "a-en", 1), (2, "b-en", 1), (3, "c-en", 1)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("a-en", 0.1, 1), ("b-en", 0.1, 1), ("c-en", 0.1, 1)], "source string, target_weight double, max_repeats int")
    assert not any(r.short for r in M.allocation(M.source_sizes(sizes), t).collect())


def mixed(spark, rows, targets):
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    t = spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    budget = M.allocation(M.source_sizes(sizes), t)
    return sizes, budget, M.mixture(sizes, budget)


def test_budgets_are_met_and_no_text_is_used_too_often(spark):
    rng = random.Random(2)
    rows = [(i, "a" if i % 3 else "b", rng.randrange(0, 50)) for i in range(3000)] + [(9999, None, 5), (9998, "unlisted", 5)]
    _, budget, mix = mixed(spark, rows, [("a", 1.0, 3), ("b", 3.0, 2), ("c", 1.0, 5), ("d", None, 1)])
    b, m = {r.source: r for r in budget.collect()}, mix.toPandas()
    assert b["c"].short and not b["a"].short and b["c"].budget == 0 and not b["d"].short
    for s in "ab":
        used = (m[m.source == s].tokens * m[m.source == s].copies).sum()
        assert b[s].budget - 50 < used <= b[s].budget
        assert m[m.source == s].copies.max() <= b[s].repeats
    assert not m.duplicated("doc_id").any() and set(m.source) == {"a", "b"}
    again = mixed(spark, rows[::-1], [("b", 3.0, 2), ("a", 1.0, 3), ("c", 1.0, 5), ("d", None, 1)])[2].toPandas()
    assert dict(zip(m.doc_id, m.copies)) == dict(zip(again.doc_id, again.copies))
    assert mixed(spark, [], [("a", 1.0, 3)])[2].count() == 0


def test_sources_in_any_spelling_count(spark):
    docs = spark.createDataFrame([(1, "one two", " Wire-FX-EN "), (2, None, "wire-fx-en"), (3, "x", None)], "doc_id long, text string, source string")
    assert {(r.source, r.tokens) for r in M.source_sizes(M.sized(docs)).collect()} == {("wire-fx-en", 2)}


# --- problem 8

OPEN = ["Dear {{name}},", "USD/JPY traded at ${price} today.", "Rates rose by %COUNT% points.", "The euro {verb} 0.3% today.", "円は{{ 通貨ペア }}近辺で推移した。", "Stops below __PRICE__ held.", "[insert currency pair] fell.", "【為替】円は%(price)sまで上昇した。", "Hello {{customer.first-name}}", "Dear <customer_name>, thank you for your order.", "Hi [FIRST_NAME], your statement is ready."]
# not the corpus's wordings, but most match a weak label and three are made pages; for those that don't see FRESH
PAGES = [
    "500 Internal Server Error", "HTTP 410 Gone", "Sample text only. Replace before release.", "JavaScriptをオンにしてください。", "Oops, that page is missing.", "This site needs cookies; switch them on and reload.", "Your login did time out, sign in once more.",
    "The service is temporarily swamped.", "502 Proxy Error", "お使いの環境ではクッキーが無効です。", "ただいま大変混み合っています。時間をおいてお試しください。", "Error 1020: blocked by firewall", "Please complete the captcha to proceed.", "Dummy dummy dummy dummy dummy dummy",
    "ここにタイトルを入れてください", "Sorry, this video cannot be played.", "file not found on server", "ページの読み込みに失敗しました。", "Sample text. Sample text. Sample text. Sample text.", "これは例文です。これは例文です。これは例文です。これは例文です。",
]
FINE = [
    "The template for letters has fields such as [NAME] and ${rate}, which the desk fills in.", 'Clients saw "Service unavailable" and "error 503" for an hour, and EUR/USD gapped.', "調査の質問票には{回答者}欄があり、3社が挙げた。", "Files are named prices, files named prices/{pair}_{tf}.csv, one line per bar.", "取引所では約5分間「アクセスが集中しております」との表示が出た。",
    '{"type":"batch","files":{"prices/CHFJPY_1h.csv":[1,"a"]},"errors":["CHFJPY 1h: timed out"]}', "【為替】ドル円は150", "The bank said its website was down for two hours on Friday.", "Kind regards,\nThe dealing desk", "Stops below 1.05 were left untouched when EUR/USD turned.", "下値の目処は1.6470とみられる。", "| 1 | 2 |\n|---|---|\n| 3 | 4 |",
]


# written after the classifier was settled and not used to change it; wordings that a weak label or a made page covers are left out below
FRESH = [
    "We could not complete that just now.", "That address leads nowhere.", "Nothing to see at this location.", "Hmm, the link seems broken.",
    "This content has left our platform.", "Come back in a few minutes.", "The system is busy at present.", "An unexpected condition was met.",
    "Segmentation fault (core dumped)", "NullReferenceException at Render()", "ORA-00942: table or view does not exist",
    "Gateway did not answer in time.", "Too many visitors right now.", "You are not authorised for this.", "Subscription lapsed; renew to read on.",
    "Prove that you are a person.", "Tick the box to go on.", "One more step before you proceed.", "Switch JS on.", "Client-side code is off.",
    "Dynamic features are turned off on your device.", "Body copy goes in this block.", "Lead paragraph pending.", "Headline to follow.",
    "Copy to come from editor.", "blah blah blah blah", "aaa bbb ccc aaa bbb ccc", "Text text text.", "表示する内容がありません。", "混雑のため表示を制限しています。",
    "しばらく時間をあけてください。", "この先は会員の方のみ閲覧できます。", "URLが正しくありません。", "原稿待ち", "本文は後日掲載します。", "あああああああああ", "画像認証をお願いします。",
    "The pair closed at ~PRICE~ yesterday.", "The yen moved by ??? pips.", "Rates: |RATE|", "Dear CUSTOMER_NAME_HERE,",
    "The index rose <<<n>>> points.", "Sales came to (amount) in (month).", "円は■■円で引けた。", "ドルは△△まで上げた。",
]


@pytest.fixture(scope="module")
def learned(spark):
    return R.trained(R.lot_of(R.drawn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))))


def test_other_wordings_are_found_and_mentions_are_not(learned):
    model, _ = learned
    cases = OPEN + PAGES + [f"Market wrap\n\n{p}\nShare this page" for p in PAGES]
    hit = model.probability(T.paged(cases)) >= model.threshold
    false = model.probability(T.paged(FINE)) >= model.threshold
    assert hit.mean() >= 0.9, [c for c, h in zip(cases, hit) if not h]
    assert hit.sum() / (hit.sum() + false.sum()) >= 0.9 and false.sum() <= 1, [c for c, f in zip(FINE, false) if f]


def test_wordings_in_no_label(learned):
    """A record, not a goal: 15 of 40 are found. A linear classifier has nothing to go by where words and forms are all new."""
    model, _ = learned
    made = R.made(["a b c"] * 3, np.random.default_rng(0))[0]
    free = [x for x in FRESH if not any(x in t for t in made) and (p := T.paged([x])) and R.labels(p, T.shared([p])[0]).max() != 1]
    found = (model.probability(T.paged(free)) >= model.threshold).sum()
    assert len(free) == 40 and 12 <= found <= 40


def test_unseen_publishers(learned):
    model, (documents, positive, found, both) = learned
    assert documents > 1000 and positive > 50 and both >= 0.95 * positive and both >= 0.95 * found
    assert R.LEVELS[0] <= model.threshold <= R.LEVELS[-1]


def test_the_words_around_a_place_do_not_count(spark, learned):
    """Sentences of long documents, with a place for a word of every third: only those come out."""
    model, _ = learned
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 1500").orderBy("doc_id").limit(60).toPandas()
    pages = T.paged(list(d.text))
    plain = [pages.segment(k) for k in np.flatnonzero(~pages.groups.any(axis=1) & ~pages.signs & (pages.words > 5))][:900]
    rng = np.random.default_rng(1)
    places = ["{{amount}}", "${rate}", "[[name]]", "%(x)s", "<%= y %>", "{{{z}}}", "__TOTAL__", "#{who}"]
    texts = [R.planted(s, places[i % 8], rng) if i % 3 == 0 else s for i, s in enumerate(plain)]
    hit = model.probability(T.paged(texts)) >= model.threshold
    want = np.arange(len(texts)) % 3 == 0
    assert hit[want].mean() >= 0.9 and hit[~want].mean() <= 0.02


def test_documents_with_residue(spark):
    good = [f"The dollar rose against the yen after data number {i}. Traders saw support at 1.{i}." for i in range(300)]
    rows = [(i, t, f"p{i % 7}") for i, t in enumerate(good)] + [(1000 + i, t, f"p{i % 7}") for i, t in enumerate((OPEN + PAGES) * 4)]
    rows += [(5000, None, None), (5001, "", "p"), (5002, " \n\t", "p"), (5003, "word " * 200_000 + "\nDear {{name}},", "p"), (1000, OPEN[0], "p0"), (None, "404 Not Found", None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, publisher string, residue string, score double")
    got = R.residue(docs.drop("residue", "score"), ["doc_id"]).collect()
    assert len(got) == len(rows)
    want = {1000 + i for i in range(len((OPEN + PAGES) * 4))} | {5003, None}
    found = {r.doc_id for r in got if r.residue}
    assert len(found & want) >= 0.95 * len(want) and not found - want and 5003 in found
    assert all(r.score == 0 for r in got if r.doc_id in (5000, 5001, 5002))
    assert R.residue(docs.limit(0), ["doc_id"]).count() == 0
    assert R.residue(docs.where("doc_id < 100"), ["doc_id"]).count() == 100


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [*OPEN, *PAGES, *FINE, "", " \n", "a\x1eb", "\ud800 x", "İstanbul ﬁ １２３", "😀" * 5]
    whole = T.paged(texts)
    for i, text in enumerate(texts):
        alone = T.paged([text])
        own = np.flatnonzero(whole.owner == i)
        assert len(own) == len(alone.owner)
        ends = np.r_[whole.start, len(whole.index)]
        got = [sorted(whole.index[ends[k] : ends[k + 1]].tolist()) for k in own]
        ends = np.r_[alone.start, len(alone.index)]
        assert got == [sorted(alone.index[ends[k] : ends[k + 1]].tolist()) for k in range(len(own))]


def test_fit_separates():
    rng = np.random.default_rng(0)
    label = (rng.random(400) < 0.3).astype(np.int8)
    index = np.concatenate([[1 if y else 2, 3 + k % 5] for k, y in enumerate(label)])
    cases = R.Cases(index, np.ones(800, dtype=np.float32), np.arange(400) * 2, label, np.zeros(400, dtype=bool))
    model = R.fit(cases, epochs=40, batch=64)
    assert ((model.logit(cases.index, cases.value, cases.start) > 0) == label).all()
