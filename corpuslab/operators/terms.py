"""Term counts by group and the statistics made of them. Counts stay in long form (group, term, n): they spill, join and combine before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved


def counts(df: DataFrame, tokens: Column, *groups: str, parts: int | None = None) -> DataFrame:
    """groups, term, n. Terms are not null, and said not to be: else a join by term would filter before it counts, and whoever reads counts twice would find tokens twice.

    With ``parts`` terms are dealt by their hash to so many tasks before they are counted, so that what a task holds doesn't follow the session's number of shuffle partitions; what sums by term then needs no more shuffle.
    """
    found = df.select(*groups, F.explode(tokens).alias("term")).filter("term is not null")
    return (found.repartition(parts, "term") if parts else found).groupBy(*groups, "term").agg(F.count("*").alias("n"))


def pair_counts(df: DataFrame, tokens: Column, *groups: str) -> DataFrame:
    """``counts`` of pairs of neighbours, joined by a blank as ``text.bigrams`` does.

    Neighbours become rows before they are joined, so that pairs are made by compiled code, not by a function called for each element of an array. The key is one struct: most pairs occur once in a task,
    and for plain keys Spark asks a second, small table in front of the one that holds them, which such keys only fill.
    """
    found = df.select(*groups, tokens.alias("_found"))
    n = F.greatest(F.size("_found") - 1, F.lit(0))
    sides = F.arrays_zip(F.slice("_found", F.lit(1), n).alias("a"), F.slice("_found", F.lit(2), n).alias("b"))
    pairs = found.select(*groups, F.explode(sides).alias("_pair")).filter("_pair.a is not null and _pair.b is not null").select(*groups, F.concat("_pair.a", F.lit(" "), "_pair.b").alias("term"))
    return pairs.groupBy(F.struct(*groups, "term").alias("_key")).agg(F.count("*").alias("n")).select("_key.*", "n")


BYTES_A_TASK = 16_000_000
"""Of texts whose terms one task counts: its table of terms takes some twenty times as much."""


def parts(df: DataFrame, text: str) -> int:
    """Tasks of about ``BYTES_A_TASK`` of text, whatever the session's sizes of splits and shuffles."""
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, 1 + size // BYTES_A_TASK)


def with_rest(counted: DataFrame, group: str) -> DataFrame:
    """Adds n_rest, total and total_rest: counts of all other groups, and both sizes. Rows without a group count among the others only.

    Sizes meet null-safely and lose their null by a count: a filter on the group would go below the counts on one side, and tokens would be found once more for that side.
    """
    by_term = Window.partitionBy("term")
    totals = counted.groupBy(group).agg(F.sum("n").alias("total"), F.count(group).alias("_known"))
    grand = totals.filter("_known >= 0").agg(F.sum("total").alias("grand"))  # all; asks for the same columns, so totals are found once
    sizes = totals.filter("_known > 0").join(F.broadcast(grand)).withColumnRenamed(group, "_g")  # one row
    rest = counted.withColumn("n_rest", F.sum("n").over(by_term) - F.col("n")).join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    return rest.withColumn("total_rest", F.col("grand") - F.col("total")).drop("grand", "_known", "_g")


def log_odds(n: Column, total: Column, n_rest: Column, total_rest: Column) -> Column:
    """Difference of logits with 0.5 added, probabilities kept within 1e-9 of 0 and 1."""

    def logit(c, t):
        p = F.least(F.greatest((c + 0.5) / (t + 0.5), F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.log(p / (1 - p))

    return logit(n, total) - logit(n_rest, total_rest)


def top(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n of each group, ranked; a partial rank keeps a large group from meeting in one task."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def distinctive(counted: DataFrame, group: str, least: int = 8, n: int = 20) -> DataFrame:
    """group, term, n, score, rank: the terms of a group with the largest log odds against all others."""
    scored = with_rest(counted, group).filter(F.col("n") >= least).withColumn("score", log_odds(F.col("n"), F.col("total"), F.col("n_rest"), F.col("total_rest")))
    return top(scored, [group], [F.desc(F.round("score", 9)), F.asc("term")], n).select(group, "term", "n", "score", "rank")


def vocabulary_log_odds(fg: Column, fg_total: Column, fg_words: Column, bg: Column, bg_total: Column, bg_words: Column, alpha: float = 0.5) -> Column:
    """Smoothed ratio of shares, each side with its own vocabulary."""
    return F.log(((fg + alpha) / (fg_total + alpha * fg_words)) / ((bg + alpha) / (bg_total + alpha * bg_words)))


def foreground_words(counted: DataFrame, foreground: str, least: int = 3, n: int = 10) -> DataFrame:
    """counted: term, n and a boolean column ``foreground``. The terms most particular to it."""
    side = counted.groupBy("term").agg(F.sum(F.when(F.col(foreground), F.col("n")).otherwise(0)).alias("fg"), F.sum(F.when(~F.col(foreground), F.col("n")).otherwise(0)).alias("bg"))
    size = side.agg(F.sum("fg").alias("fgt"), F.count_if(F.col("fg") > 0).alias("fgv"), F.sum("bg").alias("bgt"), F.count_if(F.col("bg") > 0).alias("bgv"))
    scored = side.filter(F.col("fg") >= least).join(F.broadcast(size)).withColumn("score", vocabulary_log_odds(*map(F.col, ("fg", "fgt", "fgv", "bg", "bgt", "bgv"))))
    return scored.orderBy(F.desc(F.round("score", 9)), "term").limit(n).select("term", "fg", "bg", "score")


def fixed_vocabulary(counted: DataFrame, group: str, least_groups: int = 2, most: int = 8000) -> DataFrame:
    """The most frequent terms found in enough groups, ties by name."""
    total = counted.groupBy("term").agg(F.sum("n").alias("all"), F.count("*").alias("groups")).filter(F.col("groups") >= least_groups)
    return total.orderBy(F.desc("all"), "term").limit(most).select("term")


def vocabulary_words(counted: DataFrame, group: str, least_groups: int = 2, most: int = 8000, n: int = 20) -> DataFrame:
    """Per group: log share of a term less its log share in the other groups, over one vocabulary, 0.5 added to each count of each group."""
    counted = saved(counted)  # read three times; tokens are found once
    vocabulary = fixed_vocabulary(counted, group, least_groups, most)
    groups = counted.select(group).distinct()
    full = groups.crossJoin(F.broadcast(vocabulary)).join(counted, [group, "term"], "left").select(group, "term", (F.coalesce("n", F.lit(0)) + 0.5).alias("a"))  # groups x a vocabulary of at most ``most`` terms
    by_term, by_group = Window.partitionBy("term"), Window.partitionBy(group)
    rest = full.withColumn("o", F.sum("a").over(by_term) - F.col("a"))
    scored = rest.withColumn("score", F.log(F.col("a") / F.sum("a").over(by_group)) - F.log(F.col("o") / F.sum("o").over(by_group)))
    return top(scored, [group], [F.desc(F.round("score", 9)), F.asc("term")], n).select(group, "term", (F.col("a") - 0.5).cast("long").alias("n"), "score", "rank")


def cosine(counted: DataFrame, group: str, pivot: str, *by: str) -> DataFrame:
    """Cosine of each group's counts to the pivot group's, for each value of ``by``. Counts are read once."""
    own = F.col(group) == pivot
    both = counted.withColumn("_p", F.max(F.when(own, F.col("n"))).over(Window.partitionBy(*by, "term")))  # a term has a row a group
    sums = both.groupBy(*by, group).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.coalesce(F.sum(F.col("n") * F.col("_p")), F.lit(0)).alias("dot"))
    out = sums.withColumn("pnorm", F.max(F.when(own, F.col("norm"))).over(Window.partitionBy(*by))).filter(~own & F.col("pnorm").isNotNull())
    return out.select(*by, group, (F.col("dot") / (F.col("norm") * F.col("pnorm"))).alias("cosine"))


def rate(df: DataFrame, hit: Column, *groups: str, per: int = 1000) -> DataFrame:
    """Rows per ``per`` for which ``hit`` holds."""
    return df.groupBy(*groups).agg(F.count("*").alias("rows"), (float(per) * F.avg(F.coalesce(hit, F.lit(False)).cast("int"))).alias("rate"))


def rate_ratio(df: DataFrame, hit: Column, side: Column, *groups: str) -> DataFrame:
    """Rate where ``side`` holds by the rate elsewhere; null where the latter is 0."""
    h = F.coalesce(hit, F.lit(False)).cast("int")
    return df.groupBy(*groups).agg(F.try_divide(F.avg(F.when(side, h)), F.avg(F.when(~side, h))).alias("ratio"))


def heat(counted: DataFrame, group: str, period: str, n: int = 20, letters: int = 4) -> DataFrame:
    """Shares of a group's first words by period, 0 where there are none.

    Of a group's 3n first words those of ``letters`` or more are kept, n of them: words placed after 3n never appear.
    """
    whole = counted.groupBy(group, "term").agg(F.sum("n").alias("_all"))
    first = top(whole, [group], [F.desc("_all"), F.asc("term")], 3 * n).filter(F.length("term") >= letters)
    chosen = top(first.drop("rank"), [group], [F.desc("_all"), F.asc("term")], n).select(group, "term")
    totals = counted.groupBy(group, period).agg(F.sum("n").alias("total"))
    grid = chosen.join(totals, group).join(counted, [group, period, "term"], "left")
    return grid.select(group, period, "term", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 3).alias("share"))
