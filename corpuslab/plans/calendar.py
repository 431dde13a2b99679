"""Queries on dates: windows around events, series, joins with small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import months_touched, periods
from ..operators import events, lookup, series, terms
from .base import A, CAL, T, THEMES, articles, calendar, query, r6, table
from .vocabulary import CLEAN_T, tokens

SIDES = {"open30": "pub >= event_date - 30 AND pub < event_date AS b, pub > event_date AND pub <= event_date + 30 AS f", "half60": "pub >= event_date - 60 AND pub < event_date AS b, pub >= event_date AND pub < event_date + 60 AS f"}


@query("event_before_after", f"""WITH {A}, {CAL}, x AS (SELECT idx, label, event_date, {SIDES['open30']} FROM ev CROSS JOIN a), y AS (SELECT label, event_date, count_if(b) AS n_before, count_if(f) AS n_after FROM x GROUP BY ALL)
SELECT label, strftime(event_date, '%Y-%m-%d') AS event_date, CAST(n_before AS BIGINT) AS n_before, CAST(n_after AS BIGINT) AS n_after, CASE WHEN n_before = 0 THEN CAST('inf' AS DOUBLE) ELSE round(n_after / n_before, 6) END AS ratio FROM y""")
def event_before_after(spark, d):
    out = events.before_after(articles(spark, d), "pub", calendar(spark))
    return out.select("label", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), F.col("n_before").cast("long").alias("n_before"), F.col("n_after").cast("long").alias("n_after"), r6(F.col("ratio")).alias("ratio"))


@query("event_windows", f"""WITH {A}, {CAL}, w(convention, side, lo, hi) AS (VALUES ('open30', 'before', -30, -1), ('open30', 'after', 1, 30), ('around30', 'around', -30, 30), ('half60', 'before', -60, -1), ('half60', 'after', 0, 59))
SELECT convention, side, label, count(*) AS n FROM a JOIN ev ON true JOIN w ON pub BETWEEN event_date + lo AND event_date + hi GROUP BY ALL""")
def event_windows(spark, d):
    out = None
    for convention in ("open30", "around30", "half60"):
        n = events.in_windows(articles(spark, d).select("pub"), "pub", calendar(spark), convention).groupBy("side", "label").agg(F.count("*").alias("n")).withColumn("convention", F.lit(convention))
        out = n if out is None else out.unionByName(n)
    return out


HIT = {k: "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in v) + ")" for k, v in THEMES.items()}


def _shift(convention):
    each = " UNION ALL ".join(f"SELECT label, event_date, '{k}' AS theme, b, f, CAST({h} AS INTEGER) AS hit FROM x" for k, h in HIT.items())
    return f"""WITH {A}, {CAL}, x AS (SELECT * FROM (SELECT label, event_date, text, {SIDES[convention]} FROM ev CROSS JOIN a) WHERE b OR f), z AS ({each}),
y AS (SELECT ev.label, ev.event_date, th.theme, coalesce(100 * avg(CASE WHEN b THEN hit END), 0) AS before, coalesce(100 * avg(CASE WHEN f THEN hit END), 0) AS after
 FROM ev CROSS JOIN (SELECT unnest({list(THEMES)}) AS theme) th LEFT JOIN z ON z.label = ev.label AND z.event_date = ev.event_date AND z.theme = th.theme GROUP BY ALL)"""


@query("keyword_shift", _shift("open30") + " SELECT label, theme, round(before, 6) + 0.0 AS before, round(after, 6) + 0.0 AS after, round(after - before, 6) + 0.0 AS shift FROM y ORDER BY round(abs(after - before), 9) DESC, label, theme LIMIT 10")
def keyword_shift(spark, d):
    out = events.largest_shifts(events.shares(articles(spark, d), "pub", calendar(spark), {k: X.hits(F.col("text"), v) for k, v in THEMES.items()}))
    return out.select("label", "theme", *[r6(F.col(c)).alias(c) for c in ("before", "after", "shift")])


@query("theme_shift", _shift("half60") + " SELECT label, theme, round(before, 6) + 0.0 AS before, round(after, 6) + 0.0 AS after FROM y")
def theme_shift(spark, d):
    out = events.shares(articles(spark, d), "pub", calendar(spark), {k: X.hits(F.col("text"), v) for k, v in THEMES.items()}, "half60")
    return out.select("label", "theme", *[r6(F.col(c)).alias(c) for c in ("before", "after")])


@query("event_window_terms", f"""WITH {A}, {CLEAN_T}, {CAL} SELECT label, term, count(*) AS n FROM t JOIN ev ON pub BETWEEN event_date - 30 AND event_date + 30 GROUP BY ALL HAVING count(*) >= 5""")
def event_window_terms(spark, d):
    near = events.in_windows(articles(spark, d), "pub", calendar(spark), "around30")
    return terms.counts(near, tokens(), "label").filter("n >= 5")


@query("window_background", f"""WITH {A}, {CLEAN_T}, c AS (SELECT term, count_if(pub BETWEEN DATE '2020-02-09' - 30 AND DATE '2020-02-09' + 30) AS fg, count_if(NOT pub BETWEEN DATE '2020-02-09' - 30 AND DATE '2020-02-09' + 30) AS bg FROM t GROUP BY term)
SELECT term, CAST(fg AS BIGINT) AS fg, CAST(bg AS BIGINT) AS bg FROM c WHERE fg >= 3""")
def window_background(spark, d):
    inside = F.col("pub").between(F.date_sub(F.lit("2020-02-09").cast("date"), 30), F.date_add(F.lit("2020-02-09").cast("date"), 30))
    n = terms.counts(articles(spark, d).withColumn("own", inside), tokens(), "own")
    side = lambda own: F.sum(F.when(F.col("own") == own, F.col("n")).otherwise(0)).cast("long")
    return n.groupBy("term").agg(side(True).alias("fg"), side(False).alias("bg")).filter("fg >= 3")


@query("month_overlap", f"""WITH {A}, {CAL}, m AS (SELECT label, unnest(generate_series(date_trunc('month', event_date - 30), date_trunc('month', event_date + 30), INTERVAL 1 MONTH)) AS m FROM ev)
SELECT label, count(*) AS n FROM a JOIN m ON date_trunc('month', pub) = m GROUP BY label""")
def month_overlap(spark, d):
    return events.by_month(articles(spark, d), F.col("pub"), calendar(spark)).groupBy("label").agg(F.count("*").alias("n"))


@query("nearest_event", f"""WITH {A}, {CAL}, x AS (SELECT doc_id, label, date_diff('day', event_date, pub) AS g, row_number() OVER (PARTITION BY doc_id ORDER BY abs(date_diff('day', event_date, pub)), idx) AS k FROM a CROSS JOIN ev)
SELECT doc_id, label AS nearest_event, CAST(g AS INTEGER) AS days_from_event FROM x WHERE k = 1""")
def nearest_event(spark, d):
    return events.nearest(articles(spark, d), "pub", calendar(spark)).select("doc_id", "nearest_event", "days_from_event")


@query("months_and_weeks", f"WITH {CAL} SELECT label, CAST(len(generate_series(date_trunc('month', event_date - 30), date_trunc('month', event_date + 30), INTERVAL 1 MONTH)) AS BIGINT) AS months, CAST(9 AS BIGINT) AS weeks FROM ev")
def months_and_weeks(spark, d):
    a, b = F.date_sub("event_date", 30), F.date_add("event_date", 30)
    return calendar(spark).select("label", F.size(months_touched(a, b)).cast("long").alias("months"), F.size(periods(a, b, 7)).cast("long").alias("weeks"))


@query("monthly_volume", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n FROM orders GROUP BY ALL")
def monthly_volume(spark, d):
    return series.volume(table(spark, d, "orders"), "o_orderdate")


@query("monthly_summary", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n, round(avg(o_orderkey % 1000), 1) AS mean_words, round(100 * avg(CAST(o_orderstatus = 'F' AS INTEGER)), 2) AS pct_flag, round(avg(abs(o_orderkey % 61 - 30)), 1) AS mean_days FROM orders GROUP BY ALL")
def monthly_summary(spark, d):
    return series.summary(table(spark, d, "orders"), "o_orderdate", F.col("o_orderkey") % 1000, F.col("o_orderstatus") == "F", F.col("o_orderkey") % 61 - 30)


@query("median_month", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, round(median(o_totalprice), 6) + 0.0 AS o_totalprice FROM orders GROUP BY ALL")
def median_month(spark, d):
    return series.medians(table(spark, d, "orders"), "o_orderdate", "o_totalprice").withColumn("o_totalprice", r6(F.col("o_totalprice")))


@query("entity_share", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, CAST(count_if(contains(lower(o_orderpriority), 'urgent')) AS BIGINT) AS hits, count(*) AS total, round(100 * avg(CAST(contains(lower(o_orderpriority), 'urgent') AS INTEGER)), 6) + 0.0 AS pct FROM orders GROUP BY ALL")
def entity_share(spark, d):
    out = series.share(table(spark, d, "orders"), "o_orderdate", X.mentions_entity(F.col("o_orderpriority"), "URGENT"))
    return out.withColumn("pct", r6(F.col("pct")))


@query("rolling3", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n FROM orders GROUP BY ALL) SELECT ym, n, round(avg(n) OVER (ORDER BY ym ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS rolling FROM m")
def rolling3(spark, d):
    return series.rolling(series.volume(table(spark, d, "orders"), "o_orderdate"), "n", "ym").withColumn("rolling", r6(F.col("rolling")))


@query("rolling30_spine", """WITH m AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(floor(o_totalprice)) AS value FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM m)
SELECT strftime(s.day, '%Y-%m-%d') AS day, round(value, 6) + 0.0 AS value, round(avg(value) OVER (ORDER BY s.day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 6) + 0.0 AS rolling FROM s LEFT JOIN m USING (day)""")
def rolling30_spine(spark, d):
    out = series.daily(table(spark, d, "orders").filter("o_orderkey % 7 = 0"), "o_orderdate", F.floor("o_totalprice"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[r6(F.col(c)).alias(c) for c in ("value", "rolling")])


@query("yearly_rate", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(100 * avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) + 0.0 AS pct FROM orders GROUP BY ALL")
def yearly_rate(spark, d):
    return series.yearly(table(spark, d, "orders"), "o_orderdate", F.col("o_orderstatus") == "F").withColumn("pct", r6(F.col("pct")))


@query("extent", "SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_custkey) AS keys FROM orders")
def extent(spark, d):
    return series.extent(table(spark, d, "orders"), "o_orderdate", "o_custkey")


@query("pivot_counts", "SELECT user_id, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'view')::BIGINT AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def pivot_counts(spark, d):
    return series.crosstab(table(spark, d, "events").filter(F.col("event_type").isin("click", "view")), "user_id", "event_type", ["click", "view"])


@query("crosstab_pct", "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, n, round(100 * n / sum(n) OVER (PARTITION BY source), 6) + 0.0 AS pct FROM n")
def crosstab_pct(spark, d):
    return series.shares_of(table(spark, d, "documents"), "source", "lang").withColumn("pct", r6(F.col("pct")))


@query("top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20")
def top_sources(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(20)


SCORES = [(1995, 70), (1996, 68), (1998, 64), (1999, 60), (2000, 59)]
CRACKDOWN = [(1996, 9, 5.0), (1996, 9, 7.5), (1998, 3, 2.25)]
VALUES = lambda rows: ", ".join(str(r) for r in rows)


@query("left_join_year", f"WITH s(year, overall) AS (VALUES {VALUES(SCORES)}), p AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL) SELECT CAST(p.year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, n, CAST(coalesce(overall, -1) AS INTEGER) AS overall FROM p LEFT JOIN s ON s.year = p.year")
def left_join_year(spark, d):
    p = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return lookup.enrich(p, lookup.literal(spark, SCORES, "year int, overall int"), "year").na.fill(-1, ["overall"])


@query("left_join_fanout", f"WITH s(year, month, level) AS (VALUES {VALUES(CRACKDOWN)}), p AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL) SELECT CAST(p.year AS INTEGER) AS year, CAST(p.month AS INTEGER) AS month, n, CAST(level AS DOUBLE) AS level FROM p LEFT JOIN s ON s.year = p.year AND s.month = p.month")
def left_join_fanout(spark, d):
    p = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return lookup.enrich(p, lookup.literal(spark, CRACKDOWN, "year int, month int, level double"), "year", "month")


QUESTIONS = [(2019 + y, f"{c}{k}", (y + k * 2 + ord(c)) % 5) for y in range(3) for c in "ABG" for k in range(1, 5)]


@query("subscores", f"WITH q(year, question, score) AS (VALUES {VALUES(QUESTIONS)}) SELECT CAST(year AS INTEGER) AS year, substr(question, 1, 1) AS category, CAST(sum(score) AS BIGINT) AS score, 4 * count(*) AS max_score, round(100 * sum(score) / (4 * count(*)), 6) + 0.0 AS pct FROM q GROUP BY ALL")
def subscores(spark, d):
    return lookup.subscores(lookup.literal(spark, QUESTIONS, "year int, question string, score int")).withColumn("pct", r6(F.col("pct")))


@query("code_lookup", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'other' END AS meaning FROM lineitem")
def code_lookup(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lookup.code_map(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}, "other").alias("meaning"))


@query("membership", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source HAVING count(*) >= 2")
def membership(spark, d):
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return table(spark, d, "documents").filter(F.col("source").isin("src1", "src2")).join(good, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n")).filter("n >= 2")


@query("sequential_ids", "SELECT doc_id, source || '_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 6, '0') AS id FROM documents")
def sequential_ids(spark, d):
    return lookup.ids(table(spark, d, "documents"), "source", ["doc_id"]).select("doc_id", "id")


@query("topk_largest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def topk_largest(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("nearest_order", """WITH e AS (SELECT CAST(o_orderdate AS DATE) AS event_date, o_orderkey AS idx, o_orderpriority AS label FROM orders WHERE o_totalprice >= 470000 AND month(o_orderdate) IN (3, 8)),
x AS (SELECT day, label, date_diff('day', event_date, day) AS g, row_number() OVER (PARTITION BY day ORDER BY abs(date_diff('day', event_date, day)), idx) AS k FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) CROSS JOIN e)
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, label AS nearest_event, CAST(g AS INTEGER) AS days_from_event FROM lineitem JOIN x ON CAST(l_shipdate AS DATE) = day WHERE k = 1""")
def nearest_order(spark, d):
    """Line items by the nearest large order of a March or August: an as-of merge, as for a calendar of any size."""
    o = table(spark, d, "orders").filter("o_totalprice >= 470000 and month(o_orderdate) in (3, 8)")
    e = o.select(F.col("o_orderdate").cast("date").alias("event_date"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("label"))
    out = events.nearest(table(spark, d, "lineitem"), "l_shipdate", e, most=0)
    return out.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "nearest_event", "days_from_event")


@query("event_hours", """SELECT p.event_id, CAST(count_if(e.ts >= p.ts - INTERVAL 1 HOUR AND e.ts < p.ts) AS BIGINT) AS n_before, CAST(count_if(e.ts > p.ts AND e.ts <= p.ts + INTERVAL 1 HOUR) AS BIGINT) AS n_after
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN events e ON e.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR GROUP BY p.event_id""")
def event_hours(spark, d):
    """Events in the hour before and after each purchase."""
    e = table(spark, d, "events")
    return events.before_after_hours(e, "ts", e.filter("event_type = 'purchase'").select("event_id", "ts"), "event_id", "ts")


@query("interval_join", """SELECT a.event_id, CAST(count(b.event_id) AS BIGINT) AS n, CAST(coalesce(sum(b.event_id), 0) AS BIGINT) AS ids FROM (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 60 * (1 + event_id % 7) WHEN 'error' THEN 86400 ELSE 1 END AS seconds FROM events WHERE event_type IN ('signup', 'error') AND value > 100) a
LEFT JOIN events b ON b.event_type = 'click' AND b.ts >= a.ts AND b.ts < a.ts + to_seconds(a.seconds) GROUP BY a.event_id""")
def interval_join(spark, d):
    """Clicks within some minutes of a signup or a day of an error: half-open intervals of very different lengths."""
    e = table(spark, d, "events")
    seconds = F.when(F.col("event_type") == "signup", 60 * (1 + F.col("event_id") % 7)).otherwise(86400)
    a = e.filter("event_type in ('signup', 'error') and value > 100").withColumn("first", F.col("ts").cast("timestamp"))
    a = a.select(F.col("event_id").alias("a_id"), "first", F.timestamp_micros(F.unix_micros("first") + 1_000_000 * seconds).alias("last"))
    met = events.totals_in_intervals(e.filter("event_type = 'click'"), "ts", a, "a_id", value="event_id", with_last=False)
    return met.select(F.col("a_id").alias("event_id"), "n", F.col("total").alias("ids"))


@query("median_selected", "SELECT l_returnflag, round(median(l_extendedprice), 6) + 0.0 AS price, round(median(l_quantity), 6) + 0.0 AS quantity FROM lineitem GROUP BY ALL")
def median_selected(spark, d):
    """Medians of groups that hold a third of all rows and more, by selection; quantities have few distinct values."""
    x = table(spark, d, "lineitem")
    price, quantity = (series.selected_medians(x, "l_returnflag", c, most=100).withColumnRenamed(c, n) for c, n in (("l_extendedprice", "price"), ("l_quantity", "quantity")))
    return price.join(quantity, "l_returnflag").select("l_returnflag", r6(F.col("price")).alias("price"), r6(F.col("quantity")).alias("quantity"))
