"""Labels by patterns, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def labels(text: Column, patterns: dict[str, list[str]]) -> Column:
    """Names of which any pattern is found in the lower-cased text, in the order given; one alternation a name."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(name)) for name, ps in patterns.items()]))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def filled(column: str, empty: str) -> Column:
    return F.when(F.size(column) == 0, F.array(F.lit(empty))).otherwise(F.col(column))


def cross(df: DataFrame, a: str, b: str, no_a: str, no_b: str) -> DataFrame:
    """One row for each pair of a row's own labels, with fillers for none."""
    return df.withColumn("label_a", F.explode(filled(a, no_a))).withColumn("label_b", F.explode(filled(b, no_b)))


def examples(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """First, middle (n // 2) and last row of each label, each row once. ``order`` tells a label's rows apart.

    Only labels and orders are placed, in ranges; the rows that are shown are found by them.
    """
    placed = ranges.within(ranges.placed(df.select(label, *order), [F.col(label), *map(F.col, order)]), label)
    which = F.when(F.col("_index") == 0, "first").when(F.col("_index") == F.floor(F.col("_size") / 2), "middle").when(F.col("_index") == F.col("_size") - 1, "last")
    shown = placed.withColumn("which", which).filter("which is not null").select(label, *order, "which")
    return df.join(shown, [label, *order]).select(*df.columns, "which")


def nested(df: DataFrame, a: str, b: str, weight: str, text: str, most: int = 20) -> DataFrame:
    """a, and a JSON object of b to its texts by falling weight, the first ``most`` (as shown to readers)."""
    rank = F.row_number().over(Window.partitionBy(a, b).orderBy(F.desc(weight), text))
    top = df.withColumn("_r", rank).filter(F.col("_r") <= most)
    lists = top.groupBy(a, b).agg(F.sort_array(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(text).alias("t")))).alias("l"))
    entry = F.struct(F.col(b).alias("key"), F.transform("l", lambda x: x["t"]).alias("value"))
    return lists.groupBy(a).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("lookup"))
