"""Measures of short posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from ..functions.dates import social
from . import dedup


def measures(text: Column, themes: dict[str, list[str]] | None = None) -> dict[str, Column]:
    own = {
        "exclaim": X.exclamation_rate(text),
        "caps": X.capitals_rate(text),
        "i_lang": X.pattern_rate(text, L.FIRST_PERSON),
        "confront": X.pattern_rate(text, L.CONFRONTATION),
        "length": F.size(X.words(text)).cast("double"),
    }
    return own | {k: 100.0 * X.hits(text, v).cast("int") for k, v in (themes or {}).items()}


def monthly(df: DataFrame, text: str, ym: Column, account: str, themes: dict[str, list[str]] | None = None) -> DataFrame:
    """Means of the measures by month and account, and the number of posts."""
    m = measures(F.col(text), themes)
    return df.select(ym.alias("ym"), account, *[c.alias(k) for k, c in m.items()]).groupBy("ym", account).agg(*[F.avg(k).alias(k) for k in m], F.count("*").alias("n_posts"))


def parsed(raw: DataFrame, handle: str, account: str, order: tuple[str, ...] = ("createdAt", "text")) -> DataFrame:
    """Landed posts (id, text, createdAt, counts) as rows of the posts table: line ends to blanks, no retweets, first of each id in ``order``, 1000 characters."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n|\n|\r", " ")
    ts = social(F.col("createdAt"))
    one = raw.filter(F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
    one = dedup.first(one, [F.col("id")], [*map(F.col, order)])
    return one.filter(~F.startswith(text, F.lit("RT @"))).select(
        F.col("id").cast("string").alias("tweet_id"), F.lit(handle).alias("handle"), F.lit(account).alias("account"), ts.alias("ts"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.substring(text, 1, 1000).alias("text"),
        *[F.coalesce(F.col(a), F.lit(0)).cast("long").alias(b) for a, b in (("likeCount", "likes"), ("retweetCount", "retweets"), ("replyCount", "replies"), ("quoteCount", "quotes"), ("viewCount", "views"))], "lang",
    )
