"""Deduplication with a defined survivor: the first by (priority, position)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from .scratch import saved


def first(df: DataFrame, keys: list[Column], order: list[Column], exempt: Column | None = None) -> DataFrame:
    """The first row of each key; rows for which ``exempt`` holds all stay. ``order`` tells any two rows of a key apart.

    Spark ranks within map tasks first, so a task passes on one row a key, however many rows have it; exempt rows are not ranked at all.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if exempt is None:
        return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
    free = F.coalesce(exempt, F.lit(False))
    return first(df.filter(~free), keys, order).unionAll(df.filter(free))


def earlier(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Adds ``_earlier``: a row before it has the same key. Rows with a null key have none before them.

    Firsts are found by a minimum that is combined in map tasks; rows meet them by key, and those without a key are dealt out by their order.
    """
    o = F.struct(*order)
    firsts = df.select(key.alias("_first_key"), o.alias("_o")).filter("_first_key is not null").groupBy("_first_key").agg(F.min("_o").alias("_first"))
    keyed = df.withColumn("_key", F.coalesce(F.concat(F.lit("="), key), F.concat_ws("-", *[F.col(c).cast("string") for c in order])))
    joined = keyed.join(firsts.withColumn("_first_key", F.concat(F.lit("="), F.col("_first_key"))), F.col("_key") == F.col("_first_key"), "left")
    return joined.withColumn("_earlier", F.coalesce(o > F.col("_first"), F.lit(False))).drop("_key", "_first_key", "_first")


def union(*sources: tuple[DataFrame, str, int]) -> DataFrame:
    """Sources (rows, label, priority) one after the other, with missing columns as null."""
    out = None
    for df, label, priority in sources:
        one = df.withColumns({"source_file": F.lit(label), "src_priority": F.lit(priority)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def by_url(df: DataFrame, url: str = "url", order: tuple[str, ...] = ("src_priority", "pos")) -> DataFrame:
    """Rows without a URL go."""
    return first(df.filter(F.coalesce(F.col(url), F.lit("")) != ""), [F.col(url)], [*map(F.col, order)])


def mark_title(df: DataFrame, key: Column, order: list[str], least: int = 16) -> DataFrame:
    """Adds ``title_repeats``: an earlier row has the same key of at least ``least`` characters."""
    return earlier(df, F.when(F.length(key) >= least, key), order).withColumnRenamed("_earlier", "title_repeats")


def curate(df: DataFrame, drop_domains: list[str], least_words: int = 50, order: tuple[str, ...] = ("src_priority", "pos")) -> DataFrame:
    """Adds text_clean, words_clean and ``reject_reason`` ('kept' if none). Expects url, domain, title, text; ``order`` tells all rows apart.

    The gates run in turn: repeated or missing URL, domain, error page, short as it came, repeated title, short when cleaned. A row that is dropped as short when cleaned
    still stands before later rows of its title, and a row dropped earlier does not. Keys are compared on narrow rows, for which no more of a text is read than its gates need; texts are cleaned once, and shuffled once at most, with their verdicts.
    """
    o = list(order)
    narrow = df.select(
        *o,
        F.nullif(F.coalesce(F.col("url"), F.lit("")), F.lit("")).alias("_u"),
        F.col("domain").isin(drop_domains).alias("_domain"),
        X.error_page(F.col("title"), F.col("text")).alias("_error"),
        (~X.has_words(F.col("text"), least_words)).alias("_short"),
        X.title_key(F.col("title")).alias("_t"),
    )
    reason = F.when(F.col("_u").isNull(), "no_url").when(F.col("_earlier"), "url").when(F.col("_domain"), "domain").when(F.col("_error"), "error").when(F.col("_short"), "short")
    gated = earlier(narrow, F.col("_u"), o).select(*o, reason.alias("_early"), "_t")
    titled = earlier(gated, F.when(F.col("_early").isNull() & (F.length("_t") > 15), F.col("_t")), o).select(*o, "_early", F.col("_earlier").alias("_title"))
    cleaned = df.withColumn("text_clean", X.clean_for_curation(F.col("text"))).withColumn("words_clean", X.word_count(F.col("text_clean")))
    late = F.coalesce(F.col("_early"), F.when(F.col("_title"), "title").when(F.col("words_clean") < least_words, "short_clean"), F.lit("kept"))
    return cleaned.join(titled, o).withColumn("reject_reason", late).select(*df.columns, "text_clean", "words_clean", "reject_reason")


def audit(curated: DataFrame) -> DataFrame:
    return curated.groupBy("reject_reason").agg(F.count("*").alias("rows"))


def cascade(df: DataFrame, url: Column, title: Column, order: list[Column]) -> DataFrame:
    """First by URL, then by title among the survivors; a URL counts as seen also where its row falls to its title. Blank keys are never repeated."""
    keyed = df.withColumns({"_u": F.nullif(F.coalesce(url, F.lit("")), F.lit("")), "_t": F.nullif(F.coalesce(title, F.lit("")), F.lit(""))})
    once = first(keyed, [F.col("_u")], order, F.col("_u").isNull())
    return first(once, [F.col("_t")], order, F.col("_t").isNull()).drop("_u", "_t")


def by_domain_title(df: DataFrame, domain: str, title: str, order: list[Column]) -> DataFrame:
    t = F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    return first(df, [F.col(domain), t], order, t == "")


def greedy(df: DataFrame, url: str, text: str, source: str, title: str, date: str, order: str = "pos", rounds: int = 60) -> DataFrame:
    """Row by row in ``order`` (unique): a row that shares its URL, text, or (source, title, date) with a *kept* row goes, and then blocks nothing.

    Round by round, in Spark: a row that comes first for all of its keys among the undecided is kept; rows that share a key with it go. Keys of kept rows leave
    with them, so every round decides at least the first row of each connected group; a key of a third of all rows is decided in one round by a combined minimum.
    After a few rounds chains of rows that wait for one another are decided whole.
    """
    t = F.substring(F.coalesce(F.col(title), F.lit("")), 1, 100)
    u = U.normalise(F.col(url))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = F.array_compact(
        F.array(F.when(u != "", F.concat(F.lit("u:"), u)), F.concat(F.lit("f:"), X.fingerprint(F.col(text))), F.when(t != "", F.concat_ws("\u0001", F.lit("k:"), part(source), t, part(date))))
    )
    spark = df.sparkSession
    left = saved(df.select(F.col(order).alias("o"), F.explode(keys).alias("k")).distinct())
    kept = None
    for n in range(rounds):
        decided = _firsts(left) if n < PLAIN_ROUNDS else _contracted(left)
        winners = saved(decided)
        kept = winners if kept is None else kept.union(winners)
        taken = left.join(winners, "o", "left_semi").select("k").distinct()
        gone = left.join(taken, "k", "left_semi").select("o").distinct()
        left = saved(left.join(gone, "o", "left_anti"))
        if left.isEmpty():
            return df.join(kept.select(F.col("o").alias("_kept")), F.col(order) == F.col("_kept"), "left_semi")
    # neither first nor in a chain for so many rounds: each undecided group is finished in order; groups are components of what is left
    return df.join(kept.union(_finish(spark, left)).select(F.col("o").alias("_kept")), F.col(order) == F.col("_kept"), "left_semi")


PLAIN_ROUNDS = 6


def _firsts(left: DataFrame) -> DataFrame:
    """Rows that come first for all of their keys."""
    firsts = left.groupBy("k").agg(F.min("o").alias("first"))
    return left.join(firsts, "k").groupBy("o").agg(F.min((F.col("o") == F.col("first")).cast("int")).alias("all")).filter(F.col("all") == 1).select("o")


def _contracted(left: DataFrame) -> DataFrame:
    """``_firsts``, and rows of chains that begin with them.

    A row that has one row before it in all of its keys waits for that row alone, and stays exactly if it goes. Following such rows from one to the next leads to the chain's first row; each
    round of joins doubles the steps that are known (pointer jumping), so a chain of n rows takes log n rounds. The rows an even number of steps behind a first row stay.
    """
    firsts = left.groupBy("k").agg(F.min("o").alias("first"))
    met = left.join(firsts, "k")
    seconds = met.filter("o > first").groupBy("k").agg(F.min("o").alias("second"))
    before = F.when(F.col("o") == F.col("first"), 0).when(F.col("o") == F.col("second"), 1).otherwise(2)
    state = met.join(seconds, "k", "left").withColumn("before", before).groupBy("o").agg(F.max("before").alias("most"), F.min(F.when(F.col("before") == 1, F.col("first"))).alias("p"), F.max(F.when(F.col("before") == 1, F.col("first"))).alias("p2"))
    state = saved(state)
    free = state.filter("most = 0").select("o")
    ways = saved(state.filter("most = 1 and p = p2").select("o", "p", F.lit(1).alias("odd")))
    while True:
        beyond = ways.select(F.col("o").alias("_o"), F.col("p").alias("_p"), F.col("odd").alias("_odd"))
        nxt = saved(ways.join(beyond, F.col("p") == F.col("_o"), "left").select("o", F.coalesce("_p", "p").alias("p"), ((F.col("odd") + F.coalesce("_odd", F.lit(0))) % 2).alias("odd"), F.col("_p").isNotNull().alias("moved")))
        ways = nxt.select("o", "p", "odd")
        if nxt.filter("moved").isEmpty():
            break
    stay = ways.filter("odd = 0").join(free.withColumnRenamed("o", "p"), "p", "left_semi").select("o")
    return free.union(stay)


def _finish(spark, left: DataFrame) -> DataFrame:
    """The rest by components (least order number reachable by shared keys), each walked in order."""
    label = left.withColumn("c", F.col("o"))
    while True:
        by_key = label.groupBy("k").agg(F.min("c").alias("m"))
        new = label.join(by_key, "k").groupBy("o").agg(F.min("m").alias("m"))
        nxt = saved(label.select("o", "k").join(new, "o").select("o", "k", F.col("m").alias("c")))
        if nxt.join(label.select("o", "k", F.col("c").alias("before")), ["o", "k"]).filter("c <> before").isEmpty():
            break
        label = nxt

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        out = []
        for o, keys in pdf.groupby("o", sort=True)["k"]:
            if not seen & {*keys}:
                seen |= {*keys}
                out.append(o)
        return pd.DataFrame({"o": out})

    return label.groupBy("c").applyInPandas(walk, f"o {left.schema['o'].dataType.simpleString()}")
