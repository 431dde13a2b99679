"""Places in a total order, without a window over all rows: ranges are sorted side by side, and what crosses their borders is one row a range.

``placed`` deals rows to ranges of the order, numbers them within their range and writes that once; counts a range then give each its offset. The number of ranges
follows the number of rows, so what is gathered on the driver (a few values a range) is small at any size. Rows that the order doesn't tell apart stand side by side, in any order.
A value of the order that a third of all rows have is one range unless the order has more columns: give one that tells rows apart.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved

ROWS_A_RANGE = 1_000_000


class Placed:
    """``rows``: the columns given, ``_range`` and ``_place`` (from 0, over all rows). ``sizes``: rows a range."""

    def __init__(self, rows: DataFrame, sizes: list[int]):
        self.rows, self.sizes = rows, sizes

    @property
    def total(self) -> int:
        return sum(self.sizes)


def placed(df: DataFrame, order: list[Column], ranges: int | None = None) -> Placed:
    """``ranges``: their number; by default one for each million of rows, and one for each core at least."""
    n = ranges or max(df.sparkSession.sparkContext.defaultParallelism, 1 + df.count() // ROWS_A_RANGE)
    # the number of a row within its partition stands in the low 33 bits
    dealt = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    k = F.shiftright("_m", 33).cast("int")
    counts = {r["k"]: r["n"] for r in dealt.groupBy(k.alias("k")).agg(F.count("*").alias("n")).collect()}  # one row a range
    sizes = [counts.get(i, 0) for i in range(max(counts, default=0) + 1)]
    offsets = F.array(*[F.lit(x).cast("long") for x in accumulate([0, *sizes[:-1]])])
    rows = dealt.withColumns({"_range": k, "_place": F.col("_m").bitwiseAND((1 << 33) - 1) + F.get(offsets, k)}).drop("_m")
    return Placed(rows, sizes)


def within(p: Placed, key: str) -> DataFrame:
    """p.rows with ``_index`` (from 0 within ``key``) and ``_size`` (the key's rows), for an order that starts with ``key``.

    A key's first place and its rows are combined in map tasks; rows meet them by key.
    """
    first = p.rows.groupBy(key).agg(F.min("_place").alias("_first"), F.count("*").alias("_size")).withColumnRenamed(key, "_key")
    return p.rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_index", F.col("_place") - F.col("_first")).drop("_key", "_first")


def carried(p: Placed, value: str) -> DataFrame:
    """p.rows with ``_last`` and ``_next``: the nearest non-null ``value`` at or before each row and at or after it, also beyond the borders of its range."""
    ends = p.rows.filter(F.col(value).isNotNull()).groupBy("_range").agg(F.max_by(value, "_place").alias("l"), F.min_by(value, "_place").alias("f"))
    found = {r["_range"]: (r["l"], r["f"]) for r in ends.collect()}  # one row a range
    n = len(p.sizes)
    before = list(accumulate((found.get(i, (None, None))[0] for i in range(n)), lambda a, b: a if b is None else b))
    after = list(accumulate((found.get(i, (None, None))[1] for i in reversed(range(n))), lambda a, b: a if b is None else b))[::-1]
    spark, kind = p.rows.sparkSession, p.rows.select(value).schema.fields[0].dataType.simpleString()
    border = spark.createDataFrame([(i, before[i - 1] if i else None, after[i + 1] if i + 1 < n else None) for i in range(n)], f"_range int, _b {kind}, _a {kind}")
    by = Window.partitionBy("_range").orderBy("_place")
    last = F.last(value, True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.last(value, True).over(Window.partitionBy("_range").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0))
    got = p.rows.withColumns({"_last": last, "_next": nxt}).join(F.broadcast(border), "_range")  # a row a range
    return got.withColumns({"_last": F.coalesce("_last", "_b"), "_next": F.coalesce("_next", "_a")}).drop("_a", "_b")


def summed(p: Placed, *values: str) -> DataFrame:
    """p.rows with each of ``values`` (whole numbers or decimals; nulls add nothing) added up over all rows up to each row and with it, also beyond the border of its range."""
    found = {r["_range"]: r for r in p.rows.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values]).collect()}  # one row a range
    by = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    totals = {}
    for v in values:
        before = list(accumulate([0, *(found[i][v] or 0 if i in found else 0 for i in range(len(p.sizes)))]))
        run = F.sum(v).over(by)
        totals[v] = F.coalesce(run, F.lit(0)) + F.get(F.array(*[F.lit(x).cast("decimal(38,0)") for x in before]), F.col("_range"))
    return p.rows.withColumns(totals)


def at_fractions(p: Placed, key: str, fractions: list[tuple[int, int]]) -> DataFrame:
    """Rows of p at the places floor(a * (size - 1) / b) of their key, and the rows after those, with ``_index`` and ``_size``."""
    got = within(p, key)
    low = [F.floor(F.lit(a) * (F.col("_size") - 1) / b) for a, b in fractions]
    wanted = F.lit(False)
    for x in low:
        wanted = wanted | F.col("_index").isin(x, x + 1)
    return got.filter(wanted)
