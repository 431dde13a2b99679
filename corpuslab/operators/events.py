"""Rows around dated events. Calendars are small tables (a few hundred rows by contract of the caller, checked before they are broadcast)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import months_touched
from . import ranges

MOST_EVENTS = 10_000

# (days before, days after) of the first and of the last day of a side, relative to the event.
CONVENTIONS = {"open30": {"before": (-30, -1), "after": (1, 30)}, "around30": {"around": (-30, 30)}, "half60": {"before": (-60, -1), "after": (0, 59)}, "around_days30": {"around": (-30, 30)}}


def small(events: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    if events.limit(most + 1).count() > most:
        raise ValueError(f"a calendar of over {most} events")
    return F.broadcast(events)


def windows(events: DataFrame, convention: str, date: str = "event_date") -> DataFrame:
    """events with side, first and last (inclusive days)."""
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in CONVENTIONS[convention].items()])
    each = events.withColumn("_s", F.explode(sides))
    return each.select(*events.columns, F.col("_s.side").alias("side"), F.date_add(date, F.col("_s.a")).alias("first"), F.date_add(date, F.col("_s.b")).alias("last"))


def in_windows(df: DataFrame, day: str, events: DataFrame, convention: str) -> DataFrame:
    """Each row once for each window that its day is in.

    The windows are turned into days (at most 61 an event), so the join is on equal days and hashes.
    """
    w = windows(events, convention)
    days = w.withColumn("_day", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return df.join(small(days, MOST_EVENTS * 61), F.col(day) == F.col("_day")).drop("_day")


def before_after(df: DataFrame, day: str, events: DataFrame, convention: str = "open30") -> DataFrame:
    """label, n_before, n_after, ratio (infinite without any before), for every event."""
    n = in_windows(df.select(F.col(day).alias("_d")), "_d", events, convention).groupBy("label", "event_date").agg(F.count_if(F.col("side") == "before").alias("b"), F.count_if(F.col("side") == "after").alias("a"))
    out = events.join(n, ["label", "event_date"], "left").select("label", "event_date", F.coalesce("b", F.lit(0)).alias("n_before"), F.coalesce("a", F.lit(0)).alias("n_after"))
    return out.withColumn("ratio", F.when(F.col("n_before") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("n_after").cast("double"), F.col("n_before"))))


def shares(df: DataFrame, day: str, events: DataFrame, hits: dict[str, Column], convention: str = "open30") -> DataFrame:
    """label, event_date, theme, before, after, shift: percentages of rows that hit each theme; 0 without rows."""
    flagged = df.select(F.col(day).alias("_d"), F.array(*[F.struct(F.lit(k).alias("theme"), h.cast("int").alias("hit")) for k, h in hits.items()]).alias("_h"))
    each = in_windows(flagged, "_d", events, convention).select("label", "event_date", "side", F.explode("_h").alias("h"))
    pct = lambda side: 100 * F.avg(F.when(F.col("side") == side, F.col("h.hit")))
    got = each.groupBy("label", "event_date", F.col("h.theme").alias("theme")).agg(pct("before").alias("before"), pct("after").alias("after"))
    grid = events.select("label", "event_date", F.explode(F.array(*map(F.lit, hits))).alias("theme"))
    every = grid.join(got, ["label", "event_date", "theme"], "left").na.fill(0.0, ["before", "after"])
    return every.withColumn("shift", F.col("after") - F.col("before"))


def largest_shifts(shifts: DataFrame, n: int = 10) -> DataFrame:
    return shifts.orderBy(F.desc(F.round(F.abs("shift"), 9)), "label", "theme").limit(n)


def nearest(df: DataFrame, day: str, events: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """df with nearest_event and days_from_event (negative: before it); the first listed (``idx``) of equally near ones. Null days have neither.

    Nearest events are found once for each distinct day, not for each row: among all of a calendar of at most ``most`` events, else by ``nearest_merged``, which takes any calendar.
    """
    days = df.select(F.col(day).cast("date").alias("_day")).filter("_day is not null").distinct()
    if events.limit(most + 1).count() > most:
        best = nearest_merged(days, events)
    else:
        gap = F.datediff("_day", "event_date")
        best = days.crossJoin(F.broadcast(events)).groupBy("_day").agg(F.min(F.struct(F.abs(gap).alias("x"), F.col("idx"), F.col("label"), gap.alias("g"))).alias("b"))  # distinct days x a small calendar
    found = best.select("_day", F.col("b.label").alias("nearest_event"), F.col("b.g").alias("days_from_event"))
    return df.join(found, F.col(day).cast("date") == F.col("_day"), "left").drop("_day")


def nearest_merged(days: DataFrame, events: DataFrame) -> DataFrame:
    """_day, b (x: days away, idx, label, g: signed) of the nearest event: an as-of merge in both directions.

    Days and the first listed event of each day are sorted together in ranges; each day takes the last event up to it and the next one after it, which may lie in another range.
    """
    first = events.filter("event_date is not null").groupBy(F.col("event_date").cast("date").alias("_day")).agg(F.min(F.struct("idx", "label")).alias("e"))
    event = first.select("_day", F.struct(F.col("_day").alias("at"), F.col("e.idx").alias("idx"), F.col("e.label").alias("label")).alias("e"))
    both = event.unionByName(days.select("_day"), allowMissingColumns=True)
    p = ranges.placed(both, [F.col("_day"), F.col("e").isNull()])  # an event before the rows of its own day
    near = ranges.carried(p, "e").filter("e is null")

    def to(c: str) -> Column:
        gap = F.datediff("_day", F.col(f"{c}.at"))
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(gap).alias("x"), F.col(f"{c}.idx").alias("idx"), F.col(f"{c}.label").alias("label"), gap.alias("g")))

    return near.select("_day", F.least(to("_last"), to("_next")).alias("b")).filter("b is not null")


def in_intervals(df: DataFrame, at: str, intervals: DataFrame, first: str = "first", last: str = "last", with_first: bool = True, with_last: bool = True) -> DataFrame:
    """Each row once for each interval that its timestamp is in; ``with_first`` and ``with_last`` say which ends belong to it. Null times, null ends and empty intervals match nothing.

    An interval is entered under buckets of a width of at least its own length (a power of two of microseconds), so under two at most; a row under its bucket of each width in use. Rows
    and intervals meet by equal buckets, and ends are checked then. A row has one bucket a width, so no pair is made twice, and long intervals don't multiply short ones' buckets.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = intervals.withColumns({"_a": micros(first), "_z": micros(last)}).filter("_a <= _z")
    level = F.greatest(F.ceil(F.log2((F.col("_z") - F.col("_a") + 1).cast("double"))).cast("int"), F.lit(0))
    ends = ends.withColumn("_level", level + (F.call_function("shiftleft", F.lit(1).cast("long"), level) <= F.col("_z") - F.col("_a")).cast("int"))  # doubles round
    widths = [r[0] for r in ends.select("_level").distinct().collect()]  # 64 at most
    entered = ends.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.call_function("shiftright", F.col("_a"), F.col("_level")), F.call_function("shiftright", F.col("_z"), F.col("_level"))))))
    timed = df.withColumn("_t", micros(at)).filter("_t is not null")
    dealt = timed.withColumn("_l", F.explode(F.array(*map(F.lit, widths)) if widths else F.array().cast("array<int>"))).withColumn("_b", F.call_function("shiftright", F.col("_t"), F.col("_l")))
    low = F.col("_t") >= F.col("_a") if with_first else F.col("_t") > F.col("_a")
    high = F.col("_t") <= F.col("_z") if with_last else F.col("_t") < F.col("_z")
    return dealt.join(entered, (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_bucket")) & low & high).drop("_a", "_z", "_level", "_bucket", "_t", "_l", "_b")


def totals_in_intervals(df: DataFrame, at: str, intervals: DataFrame, *keys: str, value: str | None = None, first: str = "first", last: str = "last", with_first: bool | Column = True, with_last: bool | Column = True) -> DataFrame:
    """keys, ``n`` and ``total``: how many rows are in the intervals of each of ``keys``, and the sum of their ``value`` (whole numbers; 0 without rows). Every key has a row; intervals of equal keys count together.

    What ``in_intervals`` would pair is only counted: rows and the ends of intervals are placed in one order of time and added up along it; an interval has what is added up at its end less what is at its start.
    So the work follows rows and intervals, not pairs. ``with_first`` and ``with_last`` may differ by interval; keys can be ordered.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    added = F.col(value).cast("decimal(20,0)") if value else F.lit(0).cast("decimal(20,0)")
    timed = df.select(micros(at).alias("_t"), added.alias("_v")).filter("_t is not null")
    rows = timed.groupBy("_t").agg(F.count("*").alias("_n"), F.sum("_v").alias("_v")).withColumn("_o", F.lit(1))  # at a time: what ends before it (0), its rows, what ends with it (2)
    low, high = F.lit(with_first), F.lit(with_last)
    ends = intervals.select(*keys, micros(first).alias("_a"), micros(last).alias("_z"), low.alias("_low"), high.alias("_high"))
    full = F.coalesce((F.col("_a") < F.col("_z")) | ((F.col("_a") == F.col("_z")) & F.col("_low") & F.col("_high")), F.lit(False))
    end = lambda sign, t, o: F.struct(F.lit(sign).alias("_sign"), F.when(full, t).otherwise(0).alias("_t"), F.when(full, o).otherwise(0).alias("_o"))  # noqa: E731  empty ones start where they end
    pair = F.array(end(-1, F.col("_a"), F.when(F.col("_low"), 0).otherwise(2)), end(1, F.col("_z"), F.when(F.col("_high"), 2).otherwise(0)))
    asked = ends.select(*keys, F.explode(pair).alias("_e")).select(*keys, "_e.*")
    p = ranges.placed(asked.unionByName(rows, allowMissingColumns=True), [F.col("_t"), F.col("_o"), *map(F.col, keys)])
    met = ranges.summed(p, "_n", "_v").filter("_sign is not null")
    sums = [F.sum(F.when(F.col("_sign") < 0, -F.col(c)).otherwise(F.col(c))).cast("long").alias(n) for c, n in (("_n", "n"), ("_v", "total"))]
    return met.groupBy(*keys).agg(*sums)


def before_after_hours(df: DataFrame, at: str, marks: DataFrame, key: str, mark_at: str, hours: int = 1) -> DataFrame:
    """key, n_before in [t - hours, t), n_after in (t, t + hours], for every key of the marks; marks of one key count together."""
    t, span = F.col(mark_at).cast("timestamp"), F.make_interval(hours=F.lit(hours))
    side = lambda before, a, z: F.struct(F.lit(before).alias("_before"), a.alias("first"), z.alias("last"))
    sides = marks.select(F.col(key).alias("_k"), F.explode(F.array(side(True, t - span, t), side(False, t, t + span))).alias("_s")).select("_k", "_s.*")
    before = F.col("_before")
    n = totals_in_intervals(df, at, sides, "_k", "_before", with_first=before, with_last=~before)
    return n.groupBy(F.col("_k").alias(key)).agg(F.sum(F.when(before, F.col("n"))).alias("n_before"), F.sum(F.when(~before, F.col("n"))).alias("n_after"))


def by_month(df: DataFrame, month: Column, events: DataFrame, days: int = 30) -> DataFrame:
    """Rows of which only the month is known, for each event whose span of days touches it."""
    touched = events.withColumn("_m", F.explode(months_touched(F.date_sub("event_date", days), F.date_add("event_date", days))))
    return df.withColumn("_month", F.trunc(month, "month")).join(small(touched), F.col("_month") == F.col("_m")).drop("_m", "_month")
