"""Headlines: cleaning, keys, shingles, stories, scores and pressures, in built-in expressions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

# fixed values: a small lexicon of moves, by sign
RISES = "rose|firmed|jumped|advanced|gained|climbed"
FALLS = "fell|slipped|eased|retreated|dropped|declined"
CURRENCIES = "USD|EUR|GBP|JPY|AUD|NZD|CAD|CHF"
MOVES = rf"\b({CURRENCIES})(?:/?(?:{CURRENCIES}))? ({RISES}|{FALLS})\b"


def title(text: Column) -> Column:
    """First line of a text."""
    return F.trim(F.substring_index(text, "\n", 1))


def clean(text: Column) -> Column:
    """Without tags and common entities, blanks made one."""
    out = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normal_key(text: Column) -> Column:
    """Letters and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def shingles(key: Column, n: int = 3) -> Column:
    """Distinct character n-grams, at least one."""
    last = F.greatest(F.lit(1), F.length(key) - (n - 1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(key, i, F.lit(n))))


def story_pairs(items: DataFrame, hours: int = 12, least: float = 0.6) -> DataFrame:
    """Pairs (a < b) of items within ``hours`` whose shingles have a Jaccard of ``least`` or more.

    ``items``: id, key and ``at`` (seconds). With one row per key and time no pair is lost; with one row per class of
    equal keys at its first time (``similarity_pairs``, as its SQL has it) pairs with later copies aren't seen.
    Prefix filter: two sets this alike share one of their rarest few shingles, so only items that meet on such a
    shingle and in neighbouring time buckets are compared, and exactly. No group emits all its pairs beyond those.
    """
    sets = items.withColumn("s", shingles(F.col("key"))).withColumn("size", F.size("s"))
    tokens = sets.select("id", F.explode("s").alias("t"))
    counts = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(counts, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r"))
    keep = F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1
    head = sets.select("id", "at", "size").join(ranked, "id").select("id", "at", "size", F.explode(F.slice("r", F.lit(1), keep.cast("int"))["t"]).alias("t"))
    span = hours * 3600
    bucket = F.floor(F.col("at") / span).cast("long")
    left = head.select(F.col("id").alias("a"), "t", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"), F.col("at").alias("at_a"), F.col("size").alias("n_a"))
    right = head.select(F.col("id").alias("c"), "t", bucket.alias("b"), F.col("at").alias("at_c"), F.col("size").alias("n_c"))
    close = (F.col("a") < F.col("c")) & (F.abs(F.col("at_a") - F.col("at_c")) <= span) & (F.least("n_a", "n_c") >= least * F.greatest("n_a", "n_c") - 1e-9)
    pairs = left.join(right, ["t", "b"]).where(close).select("a", "c").distinct()  # the sets stay behind: only pairs that are compared need them
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s_a"), F.col("size").alias("n_a")), "a")
    pairs = pairs.join(sets.select(F.col("id").alias("c"), F.col("s").alias("s_c"), F.col("size").alias("n_c")), "c")
    common = F.size(F.array_intersect("s_a", "s_c"))
    jaccard = common / (F.col("n_a") + F.col("n_c") - common)
    return pairs.withColumn("jaccard", jaccard).where(F.col("jaccard") >= least - 1e-9).select("a", F.col("c").alias("b"), "jaccard")


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, cur and the score of each currency that a text says rose or fell: tanh(sum / 1.5)."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(MOVES), 1).alias("cur"), F.regexp_extract_all("text", F.lit(MOVES), 2).alias("verb"))
    said = documents.where(F.col("text").isNotNull()).select("doc_id", F.inline(pairs))
    sign = F.when(F.col("verb").rlike(f"^(?:{RISES})$"), 1).otherwise(-1)
    return said.groupBy("doc_id", "cur").agg(F.round(F.tanh(F.sum(sign) / 1.5), 3).alias("score"), F.count(F.lit(1)).alias("moves"))


def pressures(scored: DataFrame, hours: int = 48, decay: float = 12.0, shrink: float = 3.0) -> DataFrame:
    """Pressure of each currency at each midnight: sum(d * score) / (3 + sum(d)), d = exp(-age / 12 h), over 48 hours.

    ``scored``: cur, score and ``at`` (seconds). Each headline is exploded onto the midnights it reaches, so one
    aggregate gives all of them.
    """
    first = F.floor(F.col("at") / 86400).cast("long") + 1
    last = F.floor((F.col("at") + hours * 3600) / 86400).cast("long")
    reach = scored.where(F.col("at").isNotNull()).withColumn("day", F.explode(F.sequence(first, F.greatest(first, last))))
    d = F.exp(-(F.col("day") * 86400 - F.col("at")) / 3600 / decay)
    return reach.withColumn("d", d).groupBy("day", "cur").agg((F.sum(F.col("d") * F.col("score")) / (shrink + F.sum("d"))).alias("pressure"), F.count(F.lit(1)).alias("n"))


def calendar_lines(lines: DataFrame, day: str, line: str, form: str) -> DataFrame:
    """The columns and the event of each line of a calendar: time, cur, title, impact, forecast and previous (as written).

    ``form`` has these in groups: hour, minute, currency, title, impact, forecast, previous. Other lines give nothing.
    """
    part = lambda k: F.regexp_extract(line, form, k)
    hit = lines.where(F.col(line).rlike(form) & (part(1).cast("int") < 24))
    time = F.timestamp_add("MINUTE", part(1).cast("int") * 60 + part(2).cast("int"), F.col(day))
    return hit.select("*", time.alias("time"), part(3).alias("cur"), part(4).alias("title"), part(5).alias("impact"), part(6).alias("forecast"), part(7).alias("previous")).drop(day, line)
