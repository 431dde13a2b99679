"""Frames that queries start from, and the same for SQL; a registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

STOP = ["the", "and", "que", "los", "les", "des", "der", "die", "und", "une", "ción"]
FOREIGN = ["the", "and", "that", "with", "this", "for", "was", "are", "what", "not", "you"]
THEMES = {"en": ["the ", " of "], "es": ["que ", "los "], "fr": [" les ", "eaux"]}
CALENDAR = [("2020-02-09", "a"), ("2019-06-01", "b"), ("2021-05-01", "c"), ("2021-05-01", "d"), ("2020-03-21", "e")]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: url and title repeat, dates are derived from ids."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "doc_id AS pos", "text", "lang", "source", "CAST(doc_id % 3 AS INT) AS src_priority",
        "concat('http://', source, '.example.org/2021/', CAST(doc_id % 40 AS STRING), '/') AS url", "substring(text, 1, 30) AS title",
        "date_add(DATE'2019-01-01', CAST(doc_id % 2192 AS INT)) AS pub",
    )


A = """a AS (SELECT doc_id, doc_id AS pos, text, lang, source, CAST(doc_id % 3 AS INTEGER) AS src_priority,
  'http://' || source || '.example.org/2021/' || CAST(doc_id % 40 AS VARCHAR) || '/' AS url, substr(text, 1, 30) AS title,
  DATE '2019-01-01' + CAST(doc_id % 2192 AS INTEGER) AS pub FROM documents)"""


def listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ]{{3,}}'), lambda x: NOT list_contains({listed(STOP)}, x))"
T = f"t AS (SELECT doc_id, source, lang, pub, unnest({TOKENS}) AS term FROM a)"
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
CAL = "ev AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, DATE '{d}', '{x}')" for i, (d, x) in enumerate(CALENDAR)) + ") v(idx, event_date, label))"


def calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, d, x) for i, (d, x) in enumerate(CALENDAR)], "idx int, event_date string, label string").withColumn("event_date", F.to_date("event_date"))


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)
