"""Point-in-time, tolerance, interval and set joins without nested loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.times import floor_div


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: list[str], tolerance: int | None = None, strict: bool = False, tie: str | None = None, width: int | None = None) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same keys at or before it.

    ``left_at`` and ``right_at`` are whole numbers of one unit. ``strict`` wants it before; ``tolerance`` is the
    greatest age, else the values are null. Of right rows at one instant the one greatest in ``tie`` counts.
    Both sides are put into one sorted stream per key and the last right row is carried forward: no pairs. With
    ``width`` the stream is cut into blocks of it, and what comes into a block is carried over a table of one row a block,
    so a key of any size is many tasks; without, a key is one sort. Left rows with a null key or instant keep null values.
    """
    known = right.where(F.col(right_at).isNotNull())
    order = F.struct(F.col(tie), *value) if tie else F.struct(*value)
    known = known.groupBy(*by, F.col(right_at).alias("_at")).agg(F.max(F.struct(order.alias("o"), F.struct(F.col(right_at).alias("_seen"), *value).alias("v")))["v"].alias("_v"))
    side = 0 if strict else 2
    stream = left.withColumns({"_at": F.col(left_at), "_side": F.lit(side), "_v": F.lit(None).cast(known.schema["_v"].dataType), "_row": F.struct(*left.columns)})
    stream = stream.select(*by, "_at", "_side", "_v", "_row").unionByName(known.select(*by, "_at", F.lit(1).alias("_side"), "_v").withColumn("_row", F.lit(None).cast(stream.schema["_row"].dataType)))
    upto = lambda keys: Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if width is None:
        met = stream.withColumn("_v", F.last("_v", ignorenulls=True).over(upto(by))).where(F.col("_row").isNotNull())
    else:
        cut = stream.withColumn("_block", floor_div(F.col("_at"), width))
        ends = cut.groupBy(*by, "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_end"))
        into = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        met = cut.withColumn("_v", F.last("_v", ignorenulls=True).over(upto([*by, "_block"]))).where(F.col("_row").isNotNull())
        same = reduce(lambda a, b: a & b, [met[k].eqNullSafe(F.col(f"_k_{k}")) for k in (*by, "_block")])
        carried = ends.select(*(F.col(k).alias(f"_k_{k}") for k in (*by, "_block")), into.alias("_into"))
        met = met.join(carried, same, "left").withColumn("_v", F.coalesce("_v", "_into"))
    usable = F.col("_at").isNotNull()
    for k in by:
        usable = usable & F.col(k).isNotNull()
    if tolerance is not None:
        usable = usable & (F.col("_at") - F.col("_v._seen") <= tolerance)
    return met.select("_row.*", *(F.when(usable, F.col(f"_v.{c}")).alias(c) for c in value), F.when(usable, F.col("_v._seen")).alias("as_of"))


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with every span of their keys that holds them: start <= at < end (whole numbers of one unit).

    Spans are put into each bucket of ``width`` that they touch, points into theirs, and the equal join on
    the bucket is filtered: no nested loop.
    """
    buckets = F.sequence(floor_div(F.col(start), width), floor_div(F.col(end) - 1, width))
    placed = spans.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(buckets))
    here = points.withColumn("_b", floor_div(F.col(at), width))
    return here.join(placed, [*by, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def dense(rows: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """A row for each key and business day from its first to its last, 0 where there was none."""
    ends = rows.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_z"))
    calendar = ends.select(*keys, F.explode(F.sequence("_a", "_z", F.expr("INTERVAL 1 DAY"))).alias(day)).where(F.weekday(day) < 5)
    return calendar.join(rows, [*keys, day], "left").fillna(0, values)


def common(rows: DataFrame, group: list[str], key: str, at: str) -> DataFrame:
    """Instants at which every key of its group has a row, with the number of keys (n-way inner join on time)."""
    keys = rows.groupBy(*group).agg(F.count_distinct(key).alias("n"))
    each = rows.groupBy(*group, at).agg(F.count_distinct(key).alias("n"))
    return each.join(keys, [*group, "n"]).select(*group, at, "n")


def numbered(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """The place (from 1) of each row among the rows of its keys in ``order``; ``bucket`` rises with the order.

    Places within buckets plus the running counts of the buckets before: no task sorts more than a bucket's rows.
    """
    cut = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    placed = cut.withColumn("_place", inside).join(sizes, [*keys, "_bucket"])
    return placed.withColumn(name, (F.col("_place") + F.col("_ahead")).cast("long")).drop("_bucket", "_place", "_ahead")


def counted_before(points: DataFrame, asks: DataFrame, ident: str, at: str, span: int, width: int, by: list[str] | None = None, point_at: str | None = None) -> DataFrame:
    """ident and n: the points of the ask's keys in [at - span, at), all in one stream (whole numbers of one unit).

    n is the number of points before ``at`` less that before ``at - span``. Each is a running count within a bucket of
    ``width`` plus the counts of the buckets before, so an ask is two rows, no list is collected and no task holds
    more than a bucket. Asks without an instant or a key have 0.
    """
    by = by or []
    ends = F.array(F.struct(F.col(at).alias("_at"), F.lit(1).alias("_sign")), F.struct((F.col(at) - span).alias("_at"), F.lit(-1).alias("_sign")))
    probes = asks.where(F.col(at).isNotNull()).select(*by, F.col(ident).alias("_id"), F.inline(ends))
    none, when = F.lit(None).cast(dict(asks.dtypes)[ident]), point_at or at
    stream = points.where(F.col(when).isNotNull()).select(*by, none.alias("_id"), F.col(when).alias("_at"), F.lit(0).alias("_sign")).unionByName(probes)
    stream = stream.withColumn("_bucket", floor_div(F.col("_at"), width))
    point = (F.col("_sign") == 0).cast("long")
    sums = stream.groupBy(*by, "_bucket").agg(F.sum(point).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(point).over(Window.partitionBy(*by, "_bucket").orderBy("_at", F.col("_sign") == 0).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = stream.withColumn("_in", inside).where("_sign <> 0").join(sums.select(*by, "_bucket", ahead.alias("_ahead")), [*by, "_bucket"])
    counts = met.groupBy(F.col("_id").alias(ident)).agg(F.sum(F.col("_sign") * (F.col("_in") + F.col("_ahead"))).cast("long").alias("n"))
    return asks.select(ident).join(counts, ident, "left").select(ident, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def business_add(day: Column, n: int) -> Column:
    """``n`` business days (Monday to Friday) after a business day."""
    weeks, rest = divmod(n, 5)
    return F.date_add(day, 7 * weeks + rest + F.when(F.weekday(day) + rest > 4, 2).otherwise(0))


def interpolated(points: DataFrame, knots: DataFrame, by: list[str], at: str, knot: str, value: str, width: int | None = None) -> DataFrame:
    """Each point with ``value`` linear between the knots of its keys before and after it, constant beyond the ends."""
    one = knots.where(F.col(knot).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(knot).alias("_a"), F.col(value).alias("_u"))
    low = asof(points, one, by, at, "_a", ["_u"], width=width).withColumnsRenamed({"_u": "_u0", "as_of": "_a0"})
    back = one.select(*by, (-F.col("_a")).alias("_n"), F.col("_u").alias("_u1"))
    both = asof(low.withColumn("_m", -F.col(at)), back, by, "_m", "_n", ["_u1"], width=width).withColumn("_a1", -F.col("as_of")).drop("_m", "as_of")
    part = (F.col(at) - F.col("_a0")) / F.nullif(F.col("_a1") - F.col("_a0"), F.lit(0))
    inside = F.when(F.col("_a1") == F.col("_a0"), F.col("_u0")).otherwise(F.col("_u0") + (F.col("_u1") - F.col("_u0")) * part)
    return both.withColumn(value, F.when(F.col("_u0").isNull(), F.col("_u1")).when(F.col("_u1").isNull(), F.col("_u0")).otherwise(inside)).drop("_u0", "_a0", "_u1", "_a1")


def first_usable(sources: list[DataFrame], keys: list[str], least: int) -> DataFrame:
    """Rows of the first source, in the order given, that has ``least`` rows of a key or more; adds ``source`` (from 0)."""
    all_ = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    sizes = all_.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return all_.join(sizes.groupBy(*keys).agg(F.min("source").alias("source")), [*keys, "source"])
