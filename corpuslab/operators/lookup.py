"""Joins with small tables, resuming, densifying, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def code_map(column: Column, pairs: dict, default=None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return m[column] if default is None else F.coalesce(m[column], F.lit(default))


def unseen(df: DataFrame, done: DataFrame | None, *keys: str) -> DataFrame:
    """Rows whose keys are not done yet; all of them without a record of what is."""
    return df if done is None else df.join(done.select(*keys).distinct(), [*keys], "left_anti")


def enrich(df: DataFrame, other: DataFrame | None, *keys: str) -> DataFrame:
    """Left join; several matches give several rows. Without the optional table the rows stay as they are."""
    return df if other is None else df.join(other, [*keys], "left")


def subscores(questions: DataFrame, most: int = 4) -> DataFrame:
    """year, question, score to year, category (first letter), score, max_score, pct."""
    return questions.groupBy("year", F.substring("question", 1, 1).alias("category")).agg(
        F.sum("score").alias("score"), (F.lit(most) * F.count("*")).alias("max_score"), (100 * F.sum("score") / (most * F.count("*"))).alias("pct")
    )


def ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key_000001`` and so on, counted within each key. ``order`` tells a key's rows apart.

    Only key and order are placed, in ranges; a key of any size takes as many ranges as it needs.
    """
    keyed = ranges.within(ranges.placed(df.select(key, *order), [F.col(key), *map(F.col, order)]), key)
    n = keyed.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], (F.col("_index") + 1).alias("_n"))
    same = F.col(key).eqNullSafe(F.col("_k"))
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    return df.join(n, same).withColumn("id", F.format_string("%s_%06d", F.col(key), "_n")).select(*df.columns, "id")
