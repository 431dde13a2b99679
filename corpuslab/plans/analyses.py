"""Whole analyses over posts and articles: each function takes the corpora and returns tidy frames by name.

posts: handle, text, ts or day, likes. articles: domain, title, text, day or month. Stop words, foreign words, calendars, themes and label patterns are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as X
from ..operators import classify, dedup, events, lookup, posts, series, terms, topics


def _native(df: DataFrame, text: Column, foreign: list[str], least: int) -> DataFrame:
    """Cleaned texts that are not mostly foreign, as ``clean``."""
    cleaned = df.withColumn("clean", X.clean_for_analysis(text))
    return cleaned.filter(~X.mostly_foreign(F.col("clean"), foreign, 0.4, least)) if foreign else cleaned


def _heading(most: int) -> Column:
    return F.concat_ws(" ", X.filled(F.col("title")), F.substring(X.filled(F.col("text")), 1, most))


def vocabulary(df: DataFrame, group: str, day: str, text: Column, stop: list[str], foreign: list[str] = (), least_foreign: int = 15, least: int = 8, n: int = 20) -> dict[str, DataFrame]:
    """Distinctive words of each group, and shares of its first words by year."""
    kept = _native(df.filter(X.filled(F.col(group)) != ""), text, list(foreign), least_foreign)
    found = X.tokens(F.col("clean"), stop, list(foreign))
    by_year = terms.counts(kept.withColumn("year", F.year(day)), found, group, "year")
    whole = by_year.groupBy(group, "term").agg(F.sum("n").alias("n"))
    return {"distinctive": terms.distinctive(whole, group, least, n), "heat": terms.heat(by_year, group, "year", n)}


def post_vocabulary(p: DataFrame, stop: list[str], foreign: list[str]) -> dict[str, DataFrame]:
    return vocabulary(p, "handle", "ts", F.col("text"), stop, foreign, 4, 8, 20)


def outlet_vocabulary(a: DataFrame, outlets: list[str], stop: list[str], foreign: list[str]) -> dict[str, DataFrame]:
    """Of titles and the first 600 characters."""
    return vocabulary(a.filter(F.col("domain").isin(outlets)), "domain", "day", _heading(600), stop, foreign, 15, 3, 20)


def release_heat(r: DataFrame, stop: list[str], foreign: list[str], first_year: int = 2019, n: int = 50) -> DataFrame:
    """First words of press releases by year; full texts, no language gate."""
    each = r.withColumns({"all": F.lit("all"), "year": F.year("day")}).filter(F.col("year") >= first_year)
    found = X.tokens(X.clean_for_analysis(F.concat_ws(" ", X.filled(F.col("title")), X.filled(F.col("text")))), stop, foreign)
    return terms.heat(terms.counts(each, found, "all", "year"), "all", "year", n).drop("all")


def bigrams(p: DataFrame, a: DataFrame, handles: list[str], outlets: list[str], stop: list[str], boilerplate: list[str] = ()) -> dict[str, DataFrame]:
    """First and distinctive word pairs of accounts, and of outlets (one row a title, 1200 characters)."""
    by_account = terms.pair_counts(p.filter(F.col("handle").isin(handles)), X.plain_tokens(F.col("text"), stop), "handle").filter(~F.col("term").isin(list(boilerplate) or [""]))
    once = dedup.by_domain_title(a.filter(F.col("domain").isin(outlets)), "domain", "title", [F.col("src_priority"), F.col("pos")])
    by_outlet = terms.pair_counts(once, X.plain_tokens(_heading(1200), stop), "domain")
    out = {}
    for name, counted, group in (("accounts", by_account, "handle"), ("outlets", by_outlet, "domain")):
        out[f"{name}_top"] = terms.top(counted, [group], [F.desc("n"), F.asc("term")], 20)
        out[f"{name}_distinctive"] = terms.distinctive(counted, group, 5, 15)
    return out


def event_framing(p: DataFrame, a: DataFrame, calendar: DataFrame, stop: list[str], foreign: list[str], least: int = 3, least_posts: int = 100, least_articles: int = 20) -> DataFrame:
    """label, side, term, n: words of both sides around each event (days for posts, months for articles).

    Events with fewer *tokens* on a side than its limit are left out.
    """
    near_posts = events.in_windows(_native(p, F.col("text"), foreign, 4).withColumn("_d", F.to_date("ts")), "_d", calendar, "around_days30")
    near_articles = events.by_month(_native(a, _heading(800), foreign, 15), F.col("day"), calendar)
    found = X.tokens(F.col("clean"), stop, foreign)
    both = terms.counts(near_posts, found, "label").withColumn("side", F.lit("government")).unionByName(terms.counts(near_articles, found, "label").withColumn("side", F.lit("media")))
    sizes = both.groupBy("label").agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in ("government", "media")])
    enough = sizes.filter((F.col("government") >= least_posts) & (F.col("media") >= least_articles)).select("label")
    return both.join(events.small(enough), "label").filter(F.col("n") >= least).select("label", "side", F.translate("term", "_", " ").alias("term"), "n")


def critics(p: DataFrame, targets: dict[str, list[str]], strategies: dict[str, list[str]], until: str) -> dict[str, DataFrame]:
    """Posts that name a target or use a strategy: volume by month, counts, strategies by month, examples, the matrix and its posts, most liked."""
    marked = p.filter(F.col("ts") <= F.lit(until).cast("timestamp")).withColumns({"targets": classify.labels(F.col("text"), targets), "strategies": classify.labels(F.col("text"), strategies)})
    own = marked.filter((F.size("targets") > 0) | (F.size("strategies") > 0)).withColumn("ym", F.date_format("ts", "yyyy-MM"))
    by_strategy = own.withColumn("strategy", F.explode("strategies"))
    pairs = classify.cross(own, "targets", "strategies", "(no specific target)", "(no specific strategy)")
    return {
        "volume": series.volume(own, "ts"),
        "targets": classify.label_counts(own, "targets"),
        "strategies": classify.label_counts(own, "strategies"),
        "by_month": by_strategy.groupBy("ym", "strategy").agg(F.count("*").alias("n")),
        "examples": classify.examples(by_strategy, "strategy", ["ts", "tweet_id"]),
        "matrix": pairs.groupBy("label_b", "label_a").agg(F.count("*").alias("n")),
        "lookup": classify.nested(pairs, "label_b", "label_a", "likes", "text"),
        "tagged": own.withColumns({c: F.array_join(c, "|") for c in ("targets", "strategies")}),
        "most_liked": own.orderBy(F.desc("likes"), "tweet_id").limit(5),
    }


def rhetoric(p: DataFrame, themes: dict[str, list[str]], calendar: DataFrame, account: str, least_posts: int = 5) -> dict[str, DataFrame]:
    """Monthly measures, themes over time, measures by account (months with enough posts), one account's course, events, distinctive words."""
    ym = F.date_format("ts", "yyyy-MM")
    monthly = posts.monthly(p, "text", ym, "handle", themes)
    over = series.mean_of_means(monthly, "ym", "handle", *themes)
    smooth = monthly.filter(F.col("n_posts") >= least_posts)
    for m in ("exclaim", "caps", "i_lang", "confront", "length"):
        smooth = series.rolling(smooth, m, "ym", "handle", name=f"{m}_smooth")
    for t in themes:
        over = series.rolling(over, f"`{t}`", "ym", name=f"{t} (smooth)")
    hits = {k: X.hits(F.col("text"), v) for k, v in themes.items()}
    counted = terms.counts(p, X.vectorizer_terms(F.col("text")), "handle")
    return {
        "monthly": monthly,
        "themes": over,
        "accounts": smooth,
        "account": smooth.filter(F.col("handle") == account),
        "events": events.shares(p.withColumn("_d", F.to_date("ts")), "_d", calendar, hits, "half60"),
        "distinctive": terms.vocabulary_words(counted, "handle", 2, 8000, 20),
    }


def topic_report(df: DataFrame, vector: str, text: str, stop: list[str], k: int = 25, dimensions: int = 50, seeds: int = 10) -> dict[str, DataFrame]:
    """Clusters of reduced embeddings, their words and labels, and their shares over time and by account."""
    with_topic = topics.clusters(topics.reduced(df, vector, dimensions), k=k, seeds=seeds).drop("reduced")
    words = topics.topic_words(topics.class_tfidf(with_topic, "topic", X.vectorizer_terms(F.col(text))), "topic", stop)
    info = topics.topic_labels(words, "topic").join(with_topic.groupBy("topic").agg(F.count("*").alias("n")), "topic")
    return {"posts": with_topic, "words": words, "topics": info, "over_time": topics.over_time(with_topic, "topic", F.date_format("ts", "yyyy-MM")), "by_account": series.shares_of(with_topic, "handle", "topic")}


def releases(r: DataFrame, calendar: DataFrame, groups: dict[str, list[str]] | None = None, title_stop: list[str] | None = None, entities: list[str] = ()) -> dict[str, DataFrame]:
    """Press releases (day, title, text, word_count, days_from_event, mentions, named_entities): volume, events, groups, lengths, title words, entities, summary, findings."""
    groups = L.KEYWORD_GROUPS if groups is None else groups
    dated = r.filter(F.col("day").isNotNull() & (X.filled(F.col("text")) != ""))
    volume = series.volume(dated, "day")
    shifts = events.shares(dated, "day", calendar, {k: X.hits(F.col("text"), v) for k, v in groups.items()})
    near = events.in_windows(dated, "day", calendar, "around30")
    inside = terms.counts(near, X.title_tokens(F.col("title"), title_stop), "label")
    everywhere = terms.counts(dated.withColumn("_", F.lit(0)), X.title_tokens(F.col("title"), title_stop), "_").select("term", F.col("n").alias("all"))
    out = {
        "volume": volume,
        "events": events.before_after(dated, "day", calendar),
        "groups": shifts,
        "largest_shifts": events.largest_shifts(shifts),
        "length": series.daily(dated, "day", F.col("word_count")),
        "title_words": _title_words(inside, everywhere),
        "summary": series.summary(dated, "day", F.col("word_count"), F.col("mentions"), F.col("days_from_event")),
        "busiest": volume.orderBy(F.desc("n"), "ym").limit(5),
        "yearly": series.yearly(dated, "day", F.col("mentions")),
    }
    for e in entities:
        out[f"entity {e}"] = series.rolling(series.share(dated, "day", X.mentions_entity(F.col("named_entities"), e)), "pct", "ym")
    return out


def _title_words(inside: DataFrame, everywhere: DataFrame, least: int = 3, n: int = 10) -> DataFrame:
    """Words of titles near each event against all others, each event's own background: totals less its window, in one pass over all events."""
    totals = inside.groupBy("label").agg(F.sum("n").alias("fgt"), F.count("*").alias("fgv"))
    whole = everywhere.agg(F.sum("all").alias("allt"), F.count("*").alias("allv"))
    joined = inside.join(everywhere, "term").withColumn("bg", F.col("all") - F.col("n"))
    gone = joined.groupBy("label").agg(F.count_if(F.col("bg") == 0).alias("only"))
    size = totals.join(gone, "label").join(F.broadcast(whole)).select("label", "fgt", "fgv", (F.col("allt") - F.col("fgt")).alias("bgt"), (F.col("allv") - F.col("only")).alias("bgv"))  # a row an event
    scored = joined.filter(F.col("n") >= least).join(events.small(size), "label").withColumn("score", terms.vocabulary_log_odds(F.col("n"), F.col("fgt"), F.col("fgv"), F.col("bg"), F.col("bgt"), F.col("bgv")))
    return terms.top(scored, ["label"], [F.desc(F.round("score", 9)), F.asc("term")], n).select("label", "term", "n", "bg", "score", "rank")


def public_metrics(scores: DataFrame, polls: DataFrame, questions: DataFrame, crackdown: DataFrame, rhetoric_monthly: DataFrame | None = None) -> dict[str, DataFrame]:
    """scores: year, overall, ...; polls: day, approval, disapproval; crackdown: year, month, support. Medians by month joined with both, and sub-scores."""
    medians = series.medians(polls, "day", "approval", "disapproval")
    monthly = medians.withColumns({"year": F.substring("ym", 1, 4).cast("int"), "month": F.substring("ym", 6, 2).cast("int")})
    merged = lookup.enrich(lookup.enrich(monthly, scores, "year"), crackdown, "year", "month")
    out = {"approval": medians, "merged": merged, "subscores": lookup.subscores(questions), "questions": questions}
    if rhetoric_monthly is not None:
        out["dashboard"] = lookup.enrich(monthly, series.rolling(rhetoric_monthly, "confront", "ym").select("ym", "rolling"), "ym")
    return out


def tables_of_paper(p: DataFrame, terms_listed: list[str], government: Column, pivot: str, change: str, stop: list[str]) -> dict[str, DataFrame]:
    """Rates of terms per 1,000 posts by year, cosine to the pivot account before and after a day, and ratios of rates."""
    year = p.withColumn("year", F.year("ts"))
    flagged = year.select("year", government.alias("own"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), X.hits(F.col("text"), [t]).alias("hit")) for t in terms_listed])).alias("t")).select("year", "own", "t.term", "t.hit")
    side = year.withColumn("side", F.when(F.col("ts") < F.lit(change).cast("timestamp"), "before").otherwise("after"))
    return {
        "rates": terms.rate(flagged, F.col("hit"), "term", "year"),
        "ratios": terms.rate_ratio(flagged, F.col("hit"), F.col("own"), "term"),
        "convergence": terms.cosine(terms.counts(side, X.tokens(F.col("text"), stop), "side", "handle"), "handle", pivot, "side"),
    }
