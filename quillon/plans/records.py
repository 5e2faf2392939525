"""Queries over texts, records, nested columns, vectors and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions.times import DAY_US, floor_div, micros
from quillon.operators import bars as B, forecasting as M, joins as J, ledger as L, news as N, text as X, vectors
from quillon.plans.shared import BARS, KEY, PAIR, Registry, W, bars_of, shown, stamp
from quillon.sources.tables import SERIES, plain_pair, small, table

query = Registry()
QUERIES, ORACLE = query.queries, query.sql

TITLE = "trim(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END, ' ')"
NORMAL = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", "published_at", X.title(F.col("text")).alias("title")).withColumn("key", X.normal_key(F.col("title"))).where(F.length("key") > 0)


@query("norm_key", f"WITH t AS (SELECT doc_id, {NORMAL.format(x=TITLE)} AS key FROM documents WHERE text IS NOT NULL) SELECT doc_id, key FROM t WHERE length(key) > 0")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("doc_id", "key")


@query("norm_key_dedupe", f"WITH t AS (SELECT doc_id, {NORMAL.format(x=TITLE)} AS key FROM documents WHERE text IS NOT NULL) SELECT md5(key) AS id, min(doc_id) AS first_doc, count(*) AS copies FROM t WHERE length(key) > 0 GROUP BY key")
def norm_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal titles as one class: its id, first document and number of copies."""
    return titles(spark, sf_dir).groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).select(F.md5(F.col("key").cast("binary")).alias("id"), "first_doc", "copies")


@query("shingles", f"WITH t AS (SELECT doc_id, {NORMAL.format(x=TITLE)} AS key FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, greatest(1, length(key) - 2)), lambda i: substr(key, i, 3)))) AS s FROM t WHERE length(key) > 0) SELECT s, count(*) AS docs FROM s GROUP BY s")
def shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles hold each character trigram."""
    return titles(spark, sf_dir).select(F.explode(X.shingles(F.col("key"))).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("docs"))


@query("similarity_pairs", f"""WITH t AS (SELECT doc_id, published_at, {NORMAL.format(x=TITLE)} AS key FROM documents WHERE text IS NOT NULL AND published_at IS NOT NULL), c AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY key) AS id, key, epoch_us(published_at) // 1000000 AS sec FROM t WHERE length(key) > 0),
s AS (SELECT *, list_distinct(list_transform(generate_series(1, greatest(1, length(key) - 2)), lambda i: substr(key, i, 3))) AS s FROM c), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS k, len(a.s) + len(b.s) AS n FROM s a JOIN s b ON a.id < b.id AND abs(a.sec - b.sec) <= 604800)
SELECT DISTINCT a, b, round(k / (n - k), 6) AS jaccard FROM p WHERE k / (n - k) >= 0.6 - 1e-9""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal titles (their first documents) that were published alike within a week of one another.

    Every time of a title is judged, so no later copy is lost; copies stay one class.
    """
    t = titles(spark, sf_dir).where(F.col("published_at").isNotNull())
    items = t.groupBy("key", F.floor(micros(F.col("published_at")) / 1_000_000).cast("long").alias("at")).agg(F.min("doc_id").alias("id"))
    of = items.select("id", F.min("id").over(Window.partitionBy("key")).alias("class"))
    pairs = X.story_pairs(items, 168).join(of.select(F.col("id").alias("a"), F.col("class").alias("_x")), "a").join(of.select(F.col("id").alias("b"), F.col("class").alias("_y")), "b")
    pairs = pairs.where("_x <> _y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "jaccard").distinct()
    return pairs.select("a", "b", F.round(F.col("jaccard"), 6).alias("jaccard"))


CLEAN = "regexp_replace(text, '<[^>]+>', ' ', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    CLEAN = f"replace({CLEAN}, '{_entity}', '{_char}')"


@query("html_clean", f"SELECT doc_id, md5(trim(regexp_replace({CLEAN}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')) AS cleaned FROM documents WHERE text IS NOT NULL")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.md5(X.clean(F.col("text")).cast("binary")).alias("cleaned"))


SAID = f"""f AS (SELECT doc_id, published_at, unnest(regexp_extract_all(text, '{X.MOVES}', 1)) AS cur, unnest(regexp_extract_all(text, '{X.MOVES}', 2)) AS verb FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, any_value(published_at) AS published_at, cur, sum(CASE WHEN verb IN ({", ".join(repr(v) for v in X.RISES.split("|"))}) THEN 1 ELSE -1 END) AS v, count(*) AS moves FROM f GROUP BY doc_id, cur)"""


@query("headline_scores", f"WITH {SAID} SELECT doc_id, cur, round(tanh(v / 1.5), 3) AS score, moves FROM s")
def headline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scores(table(spark, sf_dir, "documents")).withColumn("score", F.round(F.col("score"), 3))


@query("pressures", f"""WITH {SAID}, e AS (SELECT cur, round(tanh(v / 1.5), 3) AS score, epoch_us(published_at) // 1000000 AS sec FROM s WHERE published_at IS NOT NULL),
r AS (SELECT *, unnest(generate_series(sec // 86400 + 1, greatest(sec // 86400 + 1, (sec + 172800) // 86400))) AS day FROM e), d AS (SELECT *, exp(-(day * 86400 - sec) / 3600.0 / 12) AS d FROM r)
SELECT strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day, cur, round(sum(d * score) / (3 + sum(d)), 6) AS pressure, count(*) AS n FROM d GROUP BY day, cur""")
def pressures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.floor(micros(F.col("published_at")) / 1_000_000).cast("long")
    scored = X.scores(d).join(d.select("doc_id", at.alias("at")), "doc_id")
    p = X.pressures(scored)
    return p.select(F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"), "cur", F.round(F.col("pressure"), 6).alias("pressure"), "n")


@query("headline_reading")
def headline_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's headline says of each currency: moves, policy, data, fear and intervention, in two languages."""
    return N.scores(titles(spark, sf_dir), "doc_id", "title")


PRESSURE_SQL = f"""{SAID}, e AS (SELECT cur, round(tanh(v / 1.5), 3) AS score, epoch_us(published_at) // 1000000 AS sec FROM s WHERE published_at IS NOT NULL),
r AS (SELECT *, unnest(generate_series(sec // 86400 + 1, greatest(sec // 86400 + 1, (sec + 172800) // 86400))) AS day FROM e), d AS (SELECT *, exp(-(day * 86400 - sec) / 3600.0 / 12) AS d FROM r), p AS (SELECT day, cur, sum(d * score) / (3 + sum(d)) AS p FROM d GROUP BY day, cur)"""


@query("pair_signal", f"""WITH {PRESSURE_SQL}, l AS (SELECT code AS pair, day, coalesce(sum(CASE WHEN cur = base THEN p ELSE -p END), 0) AS v FROM fx_pairs JOIN p ON cur = base OR cur = quote GROUP BY ALL)
SELECT strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day, pair, round(greatest(-1, least(1, v)), 6) AS signal FROM l""")
def pair_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News signal of each pair at each midnight: pressure of the base less that of the quote."""
    d = table(spark, sf_dir, "documents")
    at = F.floor(micros(F.col("published_at")) / 1_000_000).cast("long")
    p = X.pressures(X.scores(d).join(d.select("doc_id", at.alias("at")), "doc_id"))
    pairs = table(spark, sf_dir, "fx_pairs").select(F.col("code").alias("pair"), "base", "quote")
    signals = N.pair_signals(p.select("day", "cur", "pressure"), small(pairs), ["day"])
    return signals.select(F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"), "pair", F.round("signal", 6).alias("signal"))


TITLED = SAID.replace("f AS (", "tf_ AS (").replace("s AS (", "ts AS (").replace("FROM f GROUP", "FROM tf_ GROUP").replace("(text,", "(title,").replace("FROM documents WHERE text IS NOT NULL", f"FROM (SELECT doc_id, published_at, {TITLE} AS title FROM documents WHERE text IS NOT NULL)")


@query("prf1", f"""WITH {SAID}, {TITLED}, j AS (SELECT coalesce(s.cur, ts.cur) AS cur, sign(ts.v) AS said, sign(s.v) AS truth FROM s FULL JOIN ts ON s.doc_id = ts.doc_id AND s.cur = ts.cur), c AS (SELECT cur, count(*) FILTER (said = truth AND said <> 0) AS tp, count(*) FILTER (coalesce(said, 0) <> 0 AND said IS DISTINCT FROM truth) AS fp, count(*) FILTER (coalesce(truth, 0) <> 0 AND said IS DISTINCT FROM truth) AS fn FROM j GROUP BY cur)
SELECT cur, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's title alone gives the direction that its whole text gives, by currency: joined on document and currency."""
    d = table(spark, sf_dir, "documents")
    truth = X.scores(d).select("doc_id", "cur", F.signum("score").alias("truth"))
    heads = d.where(F.col("text").isNotNull()).select("doc_id", X.title(F.col("text")).alias("text"))
    said = X.scores(heads).select("doc_id", "cur", F.signum("score").alias("said"))
    j = truth.join(said, ["doc_id", "cur"], "full")
    differ = ~F.col("said").eqNullSafe(F.col("truth"))
    told = lambda c: F.coalesce(c, F.lit(0.0)) != 0
    c = j.groupBy("cur").agg(F.count_if((F.col("said") == F.col("truth")) & told("said")).alias("tp"), F.count_if(told("said") & differ).alias("fp"), F.count_if(told("truth") & differ).alias("fn"))
    part = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("cur", "tp", "fp", "fn", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


LINES = """l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, line FROM l WHERE line LIKE '{"type":"%}' AND json_valid(line))"""


@query("ledger_lines", f"WITH {LINES} SELECT json_extract_string(line, '$.type') AS type, json_extract_string(line, '$.tf') AS tf, count(*) AS n FROM v WHERE json_extract_string(line, '$.type') IN ('prediction', 'outcome', 'batch') GROUP BY ALL")
def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the texts' ledger lines, by type and timeframe; lines that aren't valid are left out."""
    return records(spark, sf_dir).where(F.col("type").isin("prediction", "outcome", "batch")).groupBy("type", "tf").agg(F.count(F.lit(1)).alias("n"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"))
    lines = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", line.alias("line")).where(F.col("line").startswith('{"type":"') & F.col("line").endswith("}"))
    schema = "type string, pair string, tf string, p0 double, h array<int>, m array<double>, items array<array<string>>, prev string, hash string, _bad string"
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select("doc_id", parsed.alias("r")).where(F.col("r._bad").isNull()).select("doc_id", "r.*").drop("_bad")


@query("prediction_terms", f"""WITH {LINES}, p AS (SELECT doc_id, json_extract_string(line, '$.pair') AS pair, json_extract_string(line, '$.tf') AS tf, CAST(json_extract(line, '$.p0') AS DOUBLE) AS p0, CAST(json_extract(line, '$.h') AS INTEGER[]) AS hs, CAST(json_extract(line, '$.m') AS DOUBLE[]) AS ms FROM v WHERE json_extract_string(line, '$.type') = 'prediction')
SELECT doc_id, pair, tf, p0, unnest(hs) AS h, unnest(ms) AS m FROM p""")
def prediction_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per horizon of each prediction line: the horizon and its move, zipped from two arrays."""
    p = records(spark, sf_dir).where("type = 'prediction'")
    return p.select("doc_id", "pair", "tf", "p0", F.inline(F.arrays_zip(F.col("h").alias("h"), F.col("m").alias("m"))))


@query("map_array_ops", f"""WITH c AS (SELECT root, tf, count(*) AS n FROM prices GROUP BY ALL) SELECT root, max(n) FILTER (tf = '1h') AS hourly, list_sort(list(tf)) AS tfs, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 100) AS many FROM c GROUP BY root""")
def map_array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "prices").groupBy("root", "tf").agg(F.count(F.lit(1)).alias("n"))
    m = counts.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("tf", "n"))).alias("m"))
    values = F.map_values("m")
    return m.select("root", F.try_element_at("m", F.lit("1h")).alias("hourly"), F.array_sort(F.map_keys("m")).alias("tfs"), F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter(values, lambda x: x > 100)).cast("long").alias("many"))


@query("knn_embeddings", """WITH d AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) AS dist FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, neighbour, place FROM (SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS place FROM d) WHERE place <= 10""")
def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every query (ids divisible by 100), against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest(e, e.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding").select("query", "neighbour", F.col("place").cast("long").alias("place"))


@query("medoid", f"""WITH {BARS}, r AS (SELECT root, pair, tf, bar_time, CAST(round((ln(close) - ln(lag(close) OVER ({W}))) * 100000000) AS BIGINT) AS x, row_number() OVER (PARTITION BY root, pair, tf ORDER BY bar_time DESC) AS n FROM bars), l AS (SELECT * FROM r WHERE n <= 30 AND x IS NOT NULL),
d AS (SELECT a.root, a.pair, a.tf, a.n, a.x, sum(abs(a.x - b.x)) AS d FROM l a JOIN l b ON a.root = b.root AND a.pair = b.pair AND a.tf = b.tf GROUP BY ALL) SELECT root, pair, tf, arg_min(x, (d, n)) / 10000.0 AS medoid FROM d GROUP BY root, pair, tf""")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The move nearest to the others among each series' last thirty."""
    last = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc()))
    moves = bars_of(spark, sf_dir).withColumns({"x": F.round(B.log_return_bp() * 10_000).cast("long"), "n": last}).where("n <= 30 AND x IS NOT NULL")
    held = moves.groupBy(*SERIES).agg(F.collect_list(F.struct("n", "x")).alias("h"))
    far = lambda e: F.aggregate("h", F.lit(0).cast("long"), lambda acc, o: acc + F.abs(e["x"] - o["x"]))
    nearest = F.array_min(F.transform("h", lambda e: F.struct(far(e).alias("d"), e["n"].alias("n"), e["x"].alias("x"))))
    return held.select(*SERIES, (nearest["x"] / 10_000.0).alias("medoid"))


CHAIN = """o AS (SELECT root, concat_ws('|', rate_id, sid, strftime(obs_date, '%Y-%m-%d')) AS payload, row_number() OVER (PARTITION BY root ORDER BY coalesce(epoch_us(fetched_at), 0), rate_id) AS seq FROM rates),
c AS (SELECT root, seq, payload, sha256(repeat('0', 64) || payload) AS hash FROM o WHERE seq = 1 UNION ALL SELECT o.root, o.seq, o.payload, sha256(c.hash || o.payload) FROM c JOIN o ON o.root = c.root AND o.seq = c.seq + 1)"""


@query("hash_chain", f"WITH RECURSIVE {CHAIN} SELECT root, seq, hash FROM c")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_of(spark, sf_dir).select("root", "seq", "hash")


def chain_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "rates").select("root", "rate_id", F.concat_ws("|", F.col("rate_id").cast("string"), "sid", F.date_format("obs_date", "yyyy-MM-dd")).alias("payload"), F.coalesce(micros(F.col("fetched_at")), F.lit(0)).alias("stored"))
    return L.chained(r, "root", ["stored", "rate_id"], "payload")


@query("chain_check", f"""WITH RECURSIVE {CHAIN}, b AS (SELECT root, seq, payload, coalesce(lag(hash) OVER (PARTITION BY root ORDER BY seq), repeat('0', 64)) AS prev, CASE WHEN seq % 97 = 0 THEN 'f' || substr(hash, 2) ELSE hash END AS hash FROM c),
m AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY root ORDER BY seq), repeat('0', 64)) AS before FROM b) SELECT root, count(*) FILTER (before <> prev) AS links, count(*) FILTER (sha256(prev || payload) <> hash) AS hashes FROM m GROUP BY root""")
def chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken links and wrong hashes found in chains of which every 97th hash was altered."""
    altered = F.when(F.col("seq") % 97 == 0, F.concat(F.lit("f"), F.substring("hash", 2, 63))).otherwise(F.col("hash"))
    chain = chain_of(spark, sf_dir).withColumn("hash", altered)
    found = L.broken(chain, "root").groupBy("root").agg(F.count_if(F.col("kind") == "prev").alias("links"), F.count_if(F.col("kind") == "hash").alias("hashes"))
    return chain.select("root").distinct().join(found, "root", "left").fillna(0, ["links", "hashes"])


@query("commit_lines", "WITH l AS (SELECT root, line_id, row_number() OVER (PARTITION BY root ORDER BY line_id) AS n FROM prices) SELECT root, CAST(ceil(n / 250.0) AS BIGINT) AS batch, count(*) AS lines, min(line_id) AS first_line, max(line_id) AS last_line FROM l GROUP BY ALL")
def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which batch of 250 committed each root's lines."""
    lines = J.numbered(table(spark, sf_dir, "prices").select("root", "line_id"), ["root"], floor_div(F.col("line_id"), 65_536), ["line_id"], "n")
    lines = lines.select("root", "line_id", F.ceil(F.col("n") / 250).cast("long").alias("batch"))
    return lines.groupBy("root", "batch").agg(F.count(F.lit(1)).alias("lines"), F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"))


@query("verify_rules", f"""SELECT kind, count(*) AS n FROM (SELECT 'stored before it ended' AS kind FROM prices JOIN timeframes USING (tf) WHERE fetched_at < bar_time + minutes * INTERVAL 1 MINUTE
UNION ALL SELECT 'stored twice' FROM (SELECT root, {PAIR} AS p, tf, bar_time FROM prices GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'unknown pair' FROM prices WHERE {PAIR} NOT IN (SELECT code FROM fx_pairs)
UNION ALL SELECT 'value missing' FROM rates WHERE value IS NULL UNION ALL SELECT 'known before its day' FROM rates WHERE fetched_at < obs_date UNION ALL SELECT 'weekend day' FROM prices WHERE tf = '1d' AND isodow(bar_time) > 5) GROUP BY kind""")
def verify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by rule: one small query per rule, put together."""
    p, r = table(spark, sf_dir, "prices"), table(spark, sf_dir, "rates")
    pair = plain_pair(F.col("pair"))
    minutes = small(table(spark, sf_dir, "timeframes").select("tf", "minutes"))
    codes = table(spark, sf_dir, "fx_pairs").select(F.col("code").alias("p"))
    rules = {
        "stored before it ended": p.join(minutes, "tf").where(micros(F.col("fetched_at")) < micros(F.col("bar_time")) + F.col("minutes").cast("long") * 60_000_000),
        "stored twice": p.groupBy("root", pair.alias("p"), "tf", "bar_time").count().where(F.col("count") > 1),
        "unknown pair": p.select(pair.alias("p")).join(codes, "p", "left_anti"),
        "value missing": r.where(F.col("value").isNull()),
        "known before its day": r.where(micros(F.col("fetched_at")) < F.unix_date("obs_date").cast("long") * DAY_US),
        "weekend day": p.where((F.col("tf") == "1d") & (F.weekday("bar_time") > 4)),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in rules.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0")


@query("forecast_drift", f"""WITH {BARS}, f AS (SELECT *, row_number() OVER ({W}) AS n, lag(ln(close), 250) OVER ({W}) AS old, first_value(ln(close)) OVER ({W}) AS first FROM bars)
SELECT {KEY}, round((ln(close) - coalesce(old, first)) / least(n - 1, 250) * 5 * 10000, 5) AS drift5 FROM f WHERE n > 1""")
def forecast_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward drift forecast, five steps ahead, at every bar: one window instead of one fit per origin."""
    w = B.series_window()
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, y = F.row_number().over(w), F.log("close")
    df = bars_of(spark, sf_dir).withColumns({"n": n, "y": y}).withColumn("old", F.coalesce(F.lag("y", 250).over(w), F.first("y").over(so_far))).where("n > 1")
    return shown(df.withColumn("drift5", (F.col("y") - F.col("old")) / F.least(F.col("n") - 1, F.lit(250)) * 5 * 10_000), ["drift5"], 5)


@query("forecast_models")
def forecast_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six models from the end of each series."""
    return M.forecasts(bars_of(spark, sf_dir), [1, 5, 10, 20]).withColumn("bp", F.round("bp", 4))


@query("learned_weights", f"""WITH {BARS}, r AS (SELECT *, (ln(close) - ln(lag(close) OVER ({W}))) * 10000 AS x, (ln(lead(close) OVER ({W})) - ln(close)) * 10000 AS y, (ln(close) - ln(lag(close, 5) OVER ({W}))) * 2000 AS m FROM bars),
c AS (SELECT *, stddev_pop(x) OVER ({W} ROWS 19 PRECEDING) AS s, row_number() OVER (PARTITION BY root, pair, tf ORDER BY bar_time DESC) - 1 AS age FROM r), z AS (SELECT tf, pow(0.5, age / half_life) AS w, pow(y / s, 2) AS rw, pow((x - y) / s, 2) AS mom, pow((m - y) / s, 2) AS slow FROM c JOIN timeframes USING (tf) WHERE s > 0.01 AND y IS NOT NULL AND m IS NOT NULL),
a AS (SELECT tf, count(*) AS n, (40 + sum(w)) / (40 + sum(w * rw)) AS a, (40 + sum(w)) / (40 + sum(w * mom)) AS b, (40 + sum(w)) / (40 + sum(w * slow)) AS c FROM z GROUP BY tf) SELECT tf, n, round(a / (a + b + c), 6) AS w_rw, round(b / (a + b + c), 6) AS w_mom, round(c / (a + b + c), 6) AS w_slow FROM a""")
def learned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three simple forecasts from their past errors."""
    w = B.series_window()
    lives = small(table(spark, sf_dir, "timeframes").select("tf", "half_life"))
    df = bars_of(spark, sf_dir).withColumns({"mom": B.log_return_bp(), "y": (F.log(F.lead("close").over(w)) - F.log("close")) * 10_000, "slow": B.log_return_bp(5) / 5, "rw": F.lit(0.0)})
    age = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())) - 1
    df = df.withColumns({"s": F.stddev_pop("mom").over(B.trailing(20)), "age": age}).join(lives, "tf").where((F.col("s") > 0.01) & F.col("y").isNotNull() & F.col("slow").isNotNull())
    df = df.withColumn("w", F.pow(F.lit(0.5), F.col("age") / F.col("half_life")))
    out = M.learned_weights(df, ["tf"], ["rw", "mom", "slow"], "y", "s", "w")
    return out.select("tf", "n", *(F.round(F.col(c), 6).alias(c) for c in ("w_rw", "w_mom", "w_slow")))


@query("band_multipliers")
def band_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-widths of t-shaped ranges, a driver-built dimension."""
    rows = [(nu, level, round(width, 6)) for nu in (4, 5, 6, 10, 15) for level, width in M.student_bands(nu).items()]
    return spark.createDataFrame(rows, "nu int, level int, half_width double")
