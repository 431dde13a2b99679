"""Exports of dated events as they come: their URLs, dates and countries, and the first rule that drops a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import filled


def accepted(rows: DataFrame, reason: Callable[[Column, Column], Column], order: str = "pos") -> DataFrame:
    """rows with url, domain, country, year, month and ``reason``: ``kept``, the rule of ``reason`` (URL, country), or ``seen`` where an earlier row of the URL was accepted.

    Expects article_url, ActionGeo_CountryCode, SQLDATE and MentionTimeDate as text. A URL that was only rejected before isn't seen. The first accepted row of a URL is a minimum that
    is combined in map tasks.
    """
    text = lambda c: F.trim(filled(F.col(c)))
    day = F.coalesce(F.nullif(filled(F.col("SQLDATE")), F.lit("")), filled(F.col("MentionTimeDate")))
    own = rows.withColumns({"url": text("article_url"), "country": text("ActionGeo_CountryCode"), "_day": day})
    own = own.withColumns({"domain": U.domain(F.lit(""), F.col("url")), "year": F.when(F.length("_day") >= 4, F.substring("_day", 1, 4)).otherwise(""), "month": F.when(F.length("_day") >= 6, F.substring("_day", 5, 2)).otherwise(""), "reason": reason(F.col("url"), F.col("country"))}).drop("_day")
    first = own.filter("reason = 'kept'").groupBy(F.col("url").alias("_url")).agg(F.min(order).alias("_first"))
    seen = (F.col("url") != "") & (F.col(order) > F.col("_first"))
    return own.join(first, F.col("url") == F.col("_url"), "left").withColumn("reason", F.when(seen, "seen").otherwise(F.col("reason"))).drop("_url", "_first")
