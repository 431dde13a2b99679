"""Monthly and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved


def month(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def volume(df: DataFrame, day: str) -> DataFrame:
    return df.groupBy(month(day).alias("ym")).agg(F.count("*").alias("n"))


def summary(df: DataFrame, day: str, words: Column, flag: Column, days: Column) -> DataFrame:
    """Rows, mean words (1 place), percentage flagged (2), mean absolute days (1)."""
    agg = [F.count("*").alias("n"), F.round(F.avg(words), 1).alias("mean_words"), F.round(100 * F.avg(flag.cast("int")), 2).alias("pct_flag"), F.round(F.avg(F.abs(days)), 1).alias("mean_days")]
    return df.groupBy(month(day).alias("ym")).agg(*agg)


MOST_AT_ONCE = 1_000_000
"""Rows of a group whose median is taken in one aggregate."""


def medians(df: DataFrame, day: str, *values: str, most: int = MOST_AT_ONCE) -> DataFrame:
    """Exact medians by month; nulls are left out. A month of over ``most`` rows is not gathered: its median is selected."""
    by = df.select(month(day).alias("ym"), *values)
    if df.count() <= most or by.groupBy("ym").agg(F.count("*").alias("n")).filter(F.col("n") > most).isEmpty():
        return by.groupBy("ym").agg(*[F.median(v).alias(v) for v in values])
    out = by.select("ym").distinct()
    for v in values:
        out = out.join(selected_medians(by, "ym", v, most).withColumnRenamed("ym", "_ym"), F.col("ym").eqNullSafe(F.col("_ym")), "left").drop("_ym")
    return out


def selected_medians(df: DataFrame, key: str, value: str, most: int = MOST_AT_ONCE, accuracy: int = 1000) -> DataFrame:
    """key and the exact median of ``value``, without sorting a group or holding it. Nulls and NaN are left out.

    Each pass narrows the bounds between which a group's two middle values lie: a sketch of the values that are left proposes a value a little below the middle and one a little above it, and
    exact counts below, at, between, at and above these tell where the middle is. Every pass leaves out one value at least, and nearly all rows. Sketches and counts are combined in map
    tasks. A group is done when its middle falls on a proposed value or between two parts; once at most ``most`` rows are left, the middle is picked from these.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    n, zero = F.count("*"), F.lit(0).cast("long")
    ends = rows.groupBy("_k").agg(n.alias("between"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = saved(
        ends.select(
            "_k", "lo", "hi", zero.alias("left"), "between", F.floor((F.col("between") - 1) / 2).alias("low"), F.floor(F.col("between") / 2).alias("high"),
            F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("found"),
        )
    )
    while not (wide := state.filter((F.col("between") > most) & F.col("found").isNull())).isEmpty():
        sketch = _between(rows, wide).groupBy("_k").agg(F.percentile_approx("_v", [k / accuracy for k in range(accuracy + 1)], 10 * accuracy).alias("points"))
        place = lambda c, step: F.least(F.lit(accuracy), F.greatest(F.lit(0), F.floor((F.col(c) - F.col("left")) / F.col("between") * accuracy) + step)).cast("int") + 1
        tried = saved(_by_key(wide, sketch).withColumns({"a": F.get("points", place("low", -1) - 1), "z": F.get("points", place("high", 2) - 1)}).drop("points"))
        v = F.col("_v")
        part = F.when(v < F.col("a"), 0).when(v == F.col("a"), 1).when(v < F.col("z"), 2).when(v == F.col("z"), 3).otherwise(4)
        parts = _between(rows, tried).groupBy("_k", part.alias("part")).agg(n.alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        listed = parts.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("part", "n", "lo", "hi"))).alias("parts"))  # five at most
        start = lambda i: F.col("left") + F.aggregate(F.slice("parts", 1, i), zero, lambda t, x: t + x["n"])
        placed = F.transform("parts", lambda x, i: F.struct(start(i).alias("start"), x["n"].alias("n"), x["lo"].alias("lo"), x["hi"].alias("hi")))
        at = lambda c: F.filter("placed", lambda x: (x["start"] <= F.col(c)) & (F.col(c) < x["start"] + x["n"]))[0]
        met = _by_key(tried, listed).withColumn("placed", placed).withColumns({"l": at("low"), "h": at("high")})
        found = F.when(F.col("l.start") < F.col("h.start"), 0.5 * F.col("l.hi") + 0.5 * F.col("h.lo")).when(F.col("l.lo") == F.col("l.hi"), F.col("l.lo"))
        new = met.select("_k", F.col("l.lo").alias("lo"), F.col("l.hi").alias("hi"), F.col("l.start").alias("left"), F.col("l.n").alias("between"), "low", "high", found.alias("found"))
        state = saved(state.filter((F.col("between") <= most) | F.col("found").isNotNull()).unionByName(new))
    index = lambda c: (F.col(c) - F.col("left")).cast("int")
    few = _between(rows, state.filter("found is null")).groupBy("_k", "left", "low", "high").agg(F.sort_array(F.collect_list("_v")).alias("s"))
    picked = few.select("_k", (0.5 * F.get("s", index("low")) + 0.5 * F.get("s", index("high"))).alias("found"))
    return state.filter("found is not null").select("_k", "found").unionAll(picked).toDF(key, value)


def _by_key(state: DataFrame, more: DataFrame) -> DataFrame:
    return state.join(more.withColumnRenamed("_k", "_g"), F.col("_k").eqNullSafe(F.col("_g"))).drop("_g")


MOST_SENT = 10_000
"""Groups whose bounds are sent to all rows."""


def _between(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of groups that are within the group's bounds, which are sent to them: a group's rows are not brought together. Of many groups only the large ones' bounds are sent; the others' rows are shuffled by group."""
    s = state.withColumnRenamed("_k", "_g")
    met = lambda some: rows.join(some, F.col("_k").eqNullSafe(F.col("_g")) & F.col("_v").between(F.col("lo"), F.col("hi"))).drop("_g")
    if s.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return met(F.broadcast(s))
    large = F.col("between") > MOST_AT_ONCE  # one for each million of rows at most
    return met(F.broadcast(s.filter(large))).unionByName(met(s.filter(~large)))


def share(df: DataFrame, day: str, hit: Column) -> DataFrame:
    h = F.coalesce(hit, F.lit(False))
    return df.groupBy(month(day).alias("ym")).agg(F.count_if(h).alias("hits"), F.count("*").alias("total"), (100 * F.avg(h.cast("int"))).alias("pct"))


def rolling(df: DataFrame, value: str, order: str, *groups: str, before: int = 1, after: int = 1, name: str = "rolling") -> DataFrame:
    """Mean over rows (not calendar time) around each; nulls are left out, ends have fewer rows. Series are months or days, one row each."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*(groups or [F.lit(0)])).orderBy(order).rowsBetween(-before, after)))


def daily(df: DataFrame, day: str, value: Column, width: int = 30) -> DataFrame:
    """day, value (mean, null where there is none) for every calendar day, and its centred mean: 15 days back to 14 on for 30."""
    means = df.groupBy(F.col(day).cast("date").alias("day")).agg(F.avg(value).alias("value"))
    ends = means.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return rolling(spine.join(means, "day", "left"), "value", "day", before=width // 2, after=width - width // 2 - 1)


def yearly(df: DataFrame, day: str, flag: Column) -> DataFrame:
    return df.groupBy(F.year(day).alias("year")).agg((100 * F.avg(flag.cast("int"))).alias("pct"))


def extent(df: DataFrame, day: str, key: str) -> DataFrame:
    return df.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.countDistinct(key).alias("keys"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts, 0 where there are none. ``values`` names the columns, so no pass finds them."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def shares_of(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n, pct of the row, long form."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def mean_of_means(df: DataFrame, outer: str, inner: str, *values: str) -> DataFrame:
    """Means by (outer, inner), then their unweighted means by outer."""
    once = df.groupBy(outer, inner).agg(*[F.avg(v).alias(v) for v in values])
    return once.groupBy(outer).agg(*[F.avg(v).alias(v) for v in values])
