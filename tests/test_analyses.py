"""Whole analyses run, and their parts agree with each other."""

import math

import pytest
from pyspark.sql import functions as F

from corpuslab.plans import analyses
from corpuslab.plans.base import FOREIGN, STOP, THEMES, articles, calendar


@pytest.fixture(scope="module")
def posts(spark):
    a = articles(spark, "/root/testdata/sf0.001")
    return a.selectExpr("CAST(doc_id AS STRING) AS tweet_id", "lang AS handle", "text", "CAST(pub AS TIMESTAMP) AS ts", "doc_id % 90 AS likes").cache()


@pytest.fixture(scope="module")
def news(spark):
    return articles(spark, "/root/testdata/sf0.001").withColumns({"domain": F.col("source"), "day": F.col("pub")}).cache()


def test_vocabulary(posts, news):
    one = analyses.post_vocabulary(posts, STOP, [])
    assert one["distinctive"].filter("rank = 1").count() >= 2 and one["heat"].filter("share < 0 or share > 1").count() == 0
    assert analyses.outlet_vocabulary(news, ["src0", "src1"], STOP, FOREIGN)["distinctive"].select("domain").distinct().count() <= 2
    assert analyses.release_heat(news, STOP, []).count() > 0


def test_bigrams(posts, news):
    out = analyses.bigrams(posts, news, ["en", "fr"], ["src0", "src1"], STOP, ["of the"])
    assert out["accounts_top"].filter("term = 'of the'").count() == 0 and {r.handle for r in out["accounts_top"].collect()} == {"en", "fr"}
    assert all(df.count() >= 0 for df in out.values())


def test_event_framing(spark, posts, news):
    out = analyses.event_framing(posts, news, calendar(spark), STOP, [], 2, 10, 10)
    assert {r.side for r in out.select("side").distinct().collect()} == {"government", "media"}


def test_critics(posts):
    out = analyses.critics(posts, {"the": [r"\bthe\b"], "que": [r"\bque\b"]}, {"loud": ["!!"], "table": [r"\|"]}, "2030-01-01")
    n = out["tagged"].count()
    assert sum(r.n for r in out["volume"].collect()) == n > 0 and out["most_liked"].count() == 5
    assert sum(r.n for r in out["matrix"].collect()) >= n


def test_rhetoric(spark, posts):
    out = analyses.rhetoric(posts, THEMES, calendar(spark), "en", 1)
    assert sum(r.n_posts for r in out["monthly"].collect()) == posts.count()
    assert out["themes"].filter("en < 0 or en > 100").count() == 0 and out["distinctive"].count() > 0 and out["events"].count() > 0 and out["account"].count() > 0


def test_topics(spark, posts):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").cast("string").alias("tweet_id"), "embedding")
    out = analyses.topic_report(posts.join(e, "tweet_id"), "embedding", "text", STOP, 4, 8, 1)
    assert sum(r.n for r in out["topics"].collect()) == out["posts"].count()
    assert all(math.isclose(r.s, 100) for r in out["by_account"].groupBy("handle").agg(F.sum("pct").alias("s")).collect())


def test_releases(spark, news):
    r = news.withColumns({"word_count": F.length("text"), "mentions": F.col("doc_id") % 2 == 0, "days_from_event": F.col("doc_id") % 30, "named_entities": F.lit("Ana (PER)|Oea (ORG)")})
    out = analyses.releases(r, calendar(spark), THEMES, ["the"], ["OEA"])
    assert out["busiest"].count() == 5 and out["largest_shifts"].count() == 10
    assert out["entity OEA"].filter("pct <> 100").count() == 0
    n = sum(x.n for x in out["volume"].collect())
    assert n == news.filter("text <> ''").count()
    one = out["title_words"].first()
    near = r.crossJoin(calendar(spark).filter(F.col("label") == one.label)).filter("pub between date_sub(event_date, 30) and date_add(event_date, 30)")
    from corpuslab.functions import text as X

    toks = lambda df: [t for x in df.select(X.title_tokens(F.col("title"), ["the"]).alias("t")).collect() for t in x.t]
    fg, every = toks(near), toks(news)
    assert one.n == fg.count(one.term) and one.bg == every.count(one.term) - one.n
    rest = list(every)
    for t in fg:
        rest.remove(t)
    want = math.log((one.n + 0.5) / (len(fg) + 0.5 * len(set(fg)))) - math.log((one.bg + 0.5) / (len(rest) + 0.5 * len(set(rest))))
    assert math.isclose(one.score, want, abs_tol=1e-9)


def test_public_metrics(spark):
    polls = spark.createDataFrame([("2022-09-01", 80.0, None), ("2022-09-20", 90.0, 5.0), ("2021-01-02", 70.0, 9.0)], "d string, approval double, disapproval double").withColumn("day", F.to_date("d"))
    scores = spark.createDataFrame([(2022, 59)], "year int, overall int")
    crack = spark.createDataFrame([(2022, 9, 75.0), (2022, 9, 80.0)], "year int, month int, support double")
    q = spark.createDataFrame([(2022, "A1", 4), (2022, "A2", 2)], "year int, question string, score int")
    m = spark.createDataFrame([("2022-09", 1.5)], "ym string, confront double")
    out = analyses.public_metrics(scores, polls, q, crack, m)
    rows = out["merged"].orderBy("ym").collect()
    assert len(rows) == 3 and rows[1].approval == 85.0 and rows[1].disapproval == 5.0 and rows[0].overall is None
    assert out["subscores"].first().pct == 75.0 and out["dashboard"].count() == 2


def test_tables_of_paper(posts):
    out = analyses.tables_of_paper(posts, ["the", "que"], F.col("handle") == "en", "en", "2019-04-01", STOP)
    assert out["rates"].filter("rate < 0 or rate > 1000").count() == 0 and out["ratios"].count() == 2 and out["convergence"].filter("cosine < 0 or cosine > 1.000001").count() == 0
