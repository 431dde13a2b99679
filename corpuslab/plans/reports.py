"""Whole analyses as queries that call the library's functions; exports, resumable loads, structured data of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import dates as D
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..llm.common import bounded_batches
from ..operators import lookup, topics
from ..sources import exports
from ..sources import tables as S
from ..streaming import incremental
from . import analyses, landed
from .base import A, CAL, STOP, THEMES, TOKENS, articles, calendar, listed, query, r6, table
from .calendar import HIT, SIDES
from .landed import _releases, folder
from .vocabulary import SCORED, STRIPPED

# What texts lose before their words are counted; RE2 has no look-behind, so the character before a drop capital is put back.
CLEANED = "regexp_replace(regexp_replace({t}, '<[^>]{{0,300}}>', ' ', 'g'), '(^|[^\\pL\\pN_\\pM])([A-ZÁÉÍÓÚÑÜ])\\s+([a-záéíóúñ]{{2,}})', '\\1\\2\\3', 'g')"


def found(text: str) -> str:
    """SQL of the words of a text."""
    return TOKENS.replace("lower(text)", f"lower({STRIPPED.replace('(text,', '(' + CLEANED.format(t=text) + ',')})")


# Posts of a thousand days, so that small tables have some near every event.
POSTS = landed.POSTS.replace("conv_id % 1800", "conv_id * 37 % 1000")


def posts_of(spark, d):
    days = (F.split("tweet_id", "-")[0].cast("long") * 37 % 1000).cast("int")
    return landed.posts_of(spark, d).withColumn("ts", F.date_add(F.lit("2019-01-01").cast("date"), days).cast("timestamp"))


def news_of(spark, d):
    return articles(spark, d).withColumns({"domain": F.col("source"), "day": F.col("pub")})


# Words.

HANDLES = [f"src{i}" for i in range(1000)]


@query("report_post_words", f"WITH {POSTS}, c AS (SELECT handle AS source, term, count(*) AS n FROM (SELECT handle, unnest({found('text')}) AS term FROM p) GROUP BY ALL), {SCORED.format(least=8)}".replace("SELECT source, term, CAST", "SELECT source AS handle, term, CAST"))
def report_post_words(spark, d):
    return analyses.post_vocabulary(posts_of(spark, d), STOP, [])["distinctive"].withColumn("score", r6(F.col("score")))


OUTLETS = f"c0 AS (SELECT source, CAST(year(pub) AS INTEGER) AS year, term, count(*) AS n FROM (SELECT source, pub, unnest({found(chr(40) + 'title || chr(32) || substr(text, 1, 600)' + chr(41))}) AS term FROM a) GROUP BY ALL)"


@query("report_outlet_words", f"WITH {A}, {OUTLETS}, c AS (SELECT source, term, sum(n) AS n FROM c0 GROUP BY ALL), {SCORED.format(least=3)}".replace("SELECT source, term, CAST", "SELECT source AS domain, term, CAST"))
def report_outlet_words(spark, d):
    return analyses.outlet_vocabulary(news_of(spark, d), HANDLES, STOP, [])["distinctive"].withColumn("score", r6(F.col("score")))


@query("report_outlet_heat", f"""WITH {A}, {OUTLETS}, w AS (SELECT source, term, sum(n) AS everywhere FROM c0 GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY everywhere DESC, term) AS k FROM w),
y AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY everywhere DESC, term) AS k FROM x WHERE k <= 60 AND length(term) >= 4), tot AS (SELECT source, year, sum(n) AS total FROM c0 GROUP BY ALL)
SELECT y.source AS domain, tot.year, y.term, CAST(coalesce(c0.n, 0) AS BIGINT) AS n, round(coalesce(c0.n, 0) / total, 3) AS share
FROM y JOIN tot ON tot.source = y.source LEFT JOIN c0 ON c0.source = y.source AND c0.year = tot.year AND c0.term = y.term WHERE k <= 20""")
def report_outlet_heat(spark, d):
    return analyses.outlet_vocabulary(news_of(spark, d), HANDLES, STOP, [])["heat"].withColumn("n", F.col("n").cast("long"))


@query("report_framing", f"""WITH {A}, {POSTS}, {CAL}, g AS (SELECT label, unnest({found('text')}) AS term FROM p JOIN ev ON CAST(ts AS DATE) BETWEEN event_date - 30 AND event_date + 30),
m AS (SELECT label, unnest({found('(title || chr(32) || substr(text, 1, 800))')}) AS term FROM a JOIN ev ON date_trunc('month', pub) BETWEEN date_trunc('month', event_date - 30) AND date_trunc('month', event_date + 30)),
b AS (SELECT label, 'government' AS side, term, count(*) AS n FROM g GROUP BY ALL UNION ALL SELECT label, 'media', term, count(*) FROM m GROUP BY ALL),
ok AS (SELECT label FROM b GROUP BY label HAVING sum(CASE WHEN side = 'government' THEN n ELSE 0 END) >= 300 AND sum(CASE WHEN side = 'media' THEN n ELSE 0 END) >= 20)
SELECT label, side, term, CAST(n AS BIGINT) AS n FROM b JOIN ok USING (label) WHERE n >= 3""")
def report_framing(spark, d):
    """Both window kinds, with events left out that have too few words on a side (some at each size of the tables)."""
    return analyses.event_framing(posts_of(spark, d), news_of(spark, d), calendar(spark), STOP, [], 3, 300, 20).select("label", "side", "term", F.col("n").cast("long").alias("n"))


# Rhetoric.

SHARES = ", ".join(f"avg(100.0 * CAST({h} AS INTEGER)) AS {k}" for k, h in HIT.items())
SMOOTH = "round(avg({c}) OVER (ORDER BY ym ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0"


@query("report_rhetoric_themes", f"""WITH {POSTS}, m AS (SELECT strftime(ts, '%Y-%m') AS ym, handle, {SHARES} FROM p GROUP BY ALL), q AS (SELECT ym, {", ".join(f"avg({k}) AS {k}" for k in THEMES)} FROM m GROUP BY ym)
SELECT ym, {", ".join(f"round({k}, 6) + 0.0 AS {k}, {SMOOTH.format(c=k)} AS {k}_smooth" for k in THEMES)} FROM q""")
def report_rhetoric_themes(spark, d):
    out = analyses.rhetoric(posts_of(spark, d), THEMES, calendar(spark), "user", 1)["themes"]
    return out.select("ym", *[c for k in THEMES for c in (r6(F.col(k)).alias(k), r6(F.col(f"`{k} (smooth)`")).alias(f"{k}_smooth"))])


LENGTHS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query("report_rhetoric_account", f"""WITH {POSTS}, m AS (SELECT strftime(ts, '%Y-%m') AS ym, handle, avg(CAST({LENGTHS} AS DOUBLE)) AS length, count(*) AS n_posts FROM p GROUP BY ALL HAVING count(*) >= 2)
SELECT ym, n_posts, round(length, 6) + 0.0 AS length, {SMOOTH.format(c='length')} AS length_smooth FROM m WHERE handle = 'user'""")
def report_rhetoric_account(spark, d):
    out = analyses.rhetoric(posts_of(spark, d), THEMES, calendar(spark), "user", 2)["account"]
    return out.select("ym", "n_posts", r6(F.col("length")).alias("length"), r6(F.col("length_smooth")).alias("length_smooth"))


def _around(rows: str, day: str, sides: str) -> str:
    """Percentages of rows that hit each theme on both sides of each event."""
    each = " UNION ALL ".join(f"SELECT label, event_date, '{k}' AS theme, b, f, CAST({h} AS INTEGER) AS hit FROM x" for k, h in HIT.items())
    return f"""x AS (SELECT * FROM (SELECT label, event_date, text, {sides.replace('pub', day)} FROM ev CROSS JOIN {rows}) WHERE b OR f), z AS ({each}),
y AS (SELECT ev.label, ev.event_date, th.theme, coalesce(100 * avg(CASE WHEN b THEN hit END), 0) AS before, coalesce(100 * avg(CASE WHEN f THEN hit END), 0) AS after
 FROM ev CROSS JOIN (SELECT unnest({list(THEMES)}) AS theme) th LEFT JOIN z ON z.label = ev.label AND z.event_date = ev.event_date AND z.theme = th.theme GROUP BY ALL)"""


@query("report_rhetoric_events", f"WITH {POSTS}, {CAL}, {_around('p', 'CAST(ts AS DATE)', SIDES['half60'])} SELECT label, theme, round(before, 6) + 0.0 AS before, round(after, 6) + 0.0 AS after FROM y")
def report_rhetoric_events(spark, d):
    out = analyses.rhetoric(posts_of(spark, d), THEMES, calendar(spark), "user", 1)["events"]
    return out.select("label", "theme", r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"))


# Press releases: all frames, of texts that are there and whose date can be read.

R = f"{A}, r AS (SELECT * FROM a WHERE text <> '' AND doc_id % 7 <> 0)"


def _frames(spark, d):
    r = _releases(spark, d).withColumn("word_count", F.size(X.words(F.col("text"))).cast("double")).withColumn("days_from_event", (F.col("doc_id") % 31 - 15).cast("double")).withColumn("mentions", F.contains("text", F.lit("the ")))
    said = F.when(F.col("doc_id") % 7 == 0, "sin fecha").otherwise(F.date_format("pub", "dd/MM/yyyy"))
    r = r.withColumn("day", D.flexible(said)).withColumn("named_entities", F.when(F.col("doc_id") % 3 == 0, "Ana (PER)|OEA (ORG)").otherwise("Ana (PER)"))
    return analyses.releases(r, calendar(spark), THEMES, ["the", "and"], ["OEA"])


@query("report_releases_events", f"""WITH {R}, {CAL}, x AS (SELECT idx, label, event_date, {SIDES['open30']} FROM ev CROSS JOIN r), y AS (SELECT label, event_date, count_if(b) AS n_before, count_if(f) AS n_after FROM x GROUP BY ALL)
SELECT label, CAST(n_before AS BIGINT) AS n_before, CAST(n_after AS BIGINT) AS n_after, CASE WHEN n_before = 0 THEN CAST('inf' AS DOUBLE) ELSE round(n_after / n_before, 6) END AS ratio FROM y""")
def report_releases_events(spark, d):
    return _frames(spark, d)["events"].select("label", F.col("n_before").cast("long").alias("n_before"), F.col("n_after").cast("long").alias("n_after"), r6(F.col("ratio")).alias("ratio"))


@query("report_releases_groups", f"WITH {R}, {CAL}, {_around('r', 'pub', SIDES['open30'])} SELECT label, theme, round(before, 6) + 0.0 AS before, round(after, 6) + 0.0 AS after, round(after - before, 6) + 0.0 AS shift FROM y")
def report_releases_groups(spark, d):
    return _frames(spark, d)["groups"].select("label", "theme", *[r6(F.col(c)).alias(c) for c in ("before", "after", "shift")])


@query("report_releases_length", f"""WITH {R}, m AS (SELECT pub AS day, avg(CAST({LENGTHS} AS DOUBLE)) AS value FROM r GROUP BY pub), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM m)
SELECT strftime(s.day, '%Y-%m-%d') AS day, round(value, 6) + 0.0 AS value, round(avg(value) OVER (ORDER BY s.day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 6) + 0.0 AS rolling FROM s LEFT JOIN m USING (day)""")
def report_releases_length(spark, d):
    return _frames(spark, d)["length"].select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[r6(F.col(c)).alias(c) for c in ("value", "rolling")])


@query("report_releases_summary", f"""WITH {R} SELECT strftime(pub, '%Y-%m') AS ym, count(*) AS n, round(avg(CAST({LENGTHS} AS DOUBLE)), 1) AS mean_words, round(100 * avg(CAST(contains(text, 'the ') AS INTEGER)), 2) AS pct_flag,
round(avg(abs(doc_id % 31 - 15)), 1) AS mean_days FROM r GROUP BY ym""")
def report_releases_summary(spark, d):
    return _frames(spark, d)["summary"].select("ym", "n", "mean_words", "pct_flag", "mean_days")


@query("report_releases_yearly", f"WITH {R} SELECT CAST(year(pub) AS INTEGER) AS year, round(100 * avg(CAST(contains(text, 'the ') AS INTEGER)), 6) + 0.0 AS pct FROM r GROUP BY ALL")
def report_releases_yearly(spark, d):
    return _frames(spark, d)["yearly"].withColumn("pct", r6(F.col("pct")))


@query("report_releases_entity", f"""WITH {R}, m AS (SELECT strftime(pub, '%Y-%m') AS ym, count_if(doc_id % 3 = 0) AS hits, count(*) AS total, 100 * avg(CAST(doc_id % 3 = 0 AS INTEGER)) AS pct FROM r GROUP BY ym)
SELECT ym, CAST(hits AS BIGINT) AS hits, total, round(pct, 6) + 0.0 AS pct, {SMOOTH.format(c='pct')} AS rolling FROM m""")
def report_releases_entity(spark, d):
    return _frames(spark, d)["entity OEA"].select("ym", F.col("hits").cast("long").alias("hits"), "total", r6(F.col("pct")).alias("pct"), r6(F.col("rolling")).alias("rolling"))


TITLE = f"list_filter(list_transform(regexp_split_to_array(lower(title), '\\s+'), lambda x: trim(x, '{L.TITLE_PUNCTUATION.replace(chr(39), chr(39) * 2)}')), lambda x: length(x) > 2 AND NOT list_contains(['the', 'and'], x))"


@query("report_releases_titles", f"""WITH {R}, {CAL}, t AS (SELECT doc_id, pub, unnest({TITLE}) AS term FROM r), i AS (SELECT label, term, count(*) AS n FROM t JOIN ev ON pub BETWEEN event_date - 30 AND event_date + 30 GROUP BY ALL),
e AS (SELECT term, count(*) AS every FROM t GROUP BY term), tot AS (SELECT label, sum(n) AS fgt, count(*) AS fgv FROM i GROUP BY label), whole AS (SELECT sum(every) AS allt, count(*) AS allv FROM e),
j AS (SELECT label, term, n, every - n AS bg FROM i JOIN e USING (term)), gone AS (SELECT label, count_if(bg = 0) AS own FROM j GROUP BY label),
s AS (SELECT label, term, n, bg, ln(((n + 0.5) / (fgt + 0.5 * fgv)) / ((bg + 0.5) / ((allt - fgt) + 0.5 * (allv - own)))) AS score FROM j JOIN tot USING (label) JOIN gone USING (label), whole WHERE n >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, term) AS rank FROM s)
SELECT label, term, CAST(n AS BIGINT) AS n, CAST(bg AS BIGINT) AS bg, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def report_releases_titles(spark, d):
    return _frames(spark, d)["title_words"].select("label", "term", F.col("n").cast("long").alias("n"), F.col("bg").cast("long").alias("bg"), r6(F.col("score")).alias("score"), "rank")


# Topics: clusters differ by chance, but every post is in one, and shares add up.


@query("report_topic_accounts", """WITH x AS (SELECT lang AS handle FROM documents JOIN embeddings ON doc_id = vec_id)
SELECT handle, count(*) AS n, CAST(100 AS DOUBLE) AS pct FROM x GROUP BY handle""")
def report_topic_accounts(spark, d):
    p = articles(spark, d).selectExpr("doc_id AS vec_id", "lang AS handle", "text", "CAST(pub AS TIMESTAMP) AS ts").join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    out = analyses.topic_report(p, "embedding", "text", STOP, 6, 8, 1)["by_account"]
    return out.groupBy("handle").agg(F.sum("n").alias("n"), F.round(F.sum("pct"), 6).alias("pct"))


@query("embedded_texts", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{3,}')) AS w FROM documents),
p AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) % 64 AS k, CASE WHEN CAST('0x' || substr(md5(w), 3, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM w), s AS (SELECT doc_id, k, sum(sign) AS v FROM p GROUP BY ALL)
SELECT d.doc_id, string_agg(CAST(CAST(coalesce(v, 0) AS BIGINT) AS VARCHAR), ' ' ORDER BY d.k) AS vector FROM (SELECT doc_id, unnest(range(64)) AS k FROM documents) d LEFT JOIN s ON s.doc_id = d.doc_id AND s.k = d.k GROUP BY d.doc_id""")
def embedded_texts(spark, d):
    """Vectors by a model that each task loads once."""
    bounded_batches(spark)
    out = topics.embedded(table(spark, d, "documents").select("doc_id", "text"), "text", topics.HashedWords)
    return out.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ").alias("vector"))


# Exports of dated events, by their own rules.

HOSTS = ["diario.sv", "www.skipped.com", "world.org", "www.times.com", "local.sv", "other.net"]
EXPORT = f"""e AS (SELECT page_id, page_id AS pos, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'http://' || {listed(HOSTS)}[page_id % 6 + 1] || CASE page_id % 4 WHEN 0 THEN '/deportes/' WHEN 1 THEN '/a/' ELSE '/' END || CAST(page_id // 24 AS VARCHAR) || CASE page_id % 8 WHEN 2 THEN '/mundo' ELSE '' END END AS url,
 {listed(['diario.sv', 'skipped.com', 'world.org', 'times.com', 'local.sv', 'other.net'])}[page_id % 6 + 1] AS host, CASE WHEN page_id % 5 < 3 THEN 'ES' ELSE 'US' END AS country, '2021' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '09' AS sqldate FROM pages)"""


def _export(spark, d):
    i = F.col("page_id")
    host = F.array(*map(F.lit, HOSTS))[(i % 6).cast("int")]
    tail = F.concat(F.when(i % 4 == 0, "/deportes/").when(i % 4 == 1, "/a/").otherwise("/"), F.expr("string(page_id div 24)"), F.when(i % 8 == 2, "/mundo").otherwise(""))
    url = F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit(" http://"), host, tail, F.lit(" ")))
    rows = table(spark, d, "pages").select(
        i.alias("pos"), url.alias("article_url"), F.when(i % 5 < 3, " ES").otherwise("US").alias("ActionGeo_CountryCode"), F.when(i % 2 == 0, F.concat(F.lit("2021"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("09"))).alias("SQLDATE"),
        F.concat(F.lit("2021"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("0912")).alias("MentionTimeDate"), F.lit("t").alias("title"),
    )
    path = folder(spark)
    S.write_csv(rows, path, rows.columns)
    return S.csv_rows(spark, path, rows.columns).withColumn("pos", F.col("pos").cast("long"))


def _chain(rules: str) -> str:
    return f"""WITH {EXPORT}, c AS (SELECT *, {rules} AS why FROM e), f AS (SELECT url, min(pos) AS first FROM c WHERE why = 'kept' GROUP BY url)
SELECT pos, CASE WHEN url <> '' AND pos > first THEN 'seen' ELSE why END AS reason, CASE WHEN url = '' THEN '' ELSE host END AS domain, '2021' AS year, substr(sqldate, 5, 2) AS month FROM c LEFT JOIN f USING (url)"""


SECTION = f"regexp_matches(url, '/({'|'.join(L.SKIP_SECTIONS)})/', 'i')"
SECTION_END = f"regexp_matches(url, '/({'|'.join(L.SKIP_SECTIONS)})(/|$)', 'i')"


@query("export_geo", _chain(f"CASE WHEN url = '' THEN 'no_url' WHEN host = 'skipped.com' THEN 'domain' WHEN NOT (country = 'ES' OR host IN ('diario.sv', 'local.sv')) THEN 'geo' WHEN {SECTION} THEN 'section' ELSE 'kept' END"))
def export_geo(spark, d):
    """Rows of the country or of its own outlets, each accepted URL once, with the first rule that drops a row."""
    out = exports.accepted(_export(spark, d), lambda u, c: U.geo_reason(u, c, ["diario.sv", "local.sv"], ["skipped.com"]))
    return out.select("pos", "reason", "domain", "year", "month")


@query("export_priority", _chain(f"CASE WHEN url = '' THEN 'no_url' WHEN host IN ('diario.sv', 'local.sv') THEN 'domestic' WHEN host = 'skipped.com' THEN 'domain' WHEN host NOT IN ('times.com', 'world.org') THEN 'not_priority' WHEN {SECTION_END} THEN 'section' ELSE 'kept' END"))
def export_priority(spark, d):
    out = exports.accepted(_export(spark, d), lambda u, c: U.priority_reason(u, ["times.com", "world.org"], ["diario.sv", "local.sv"], ["skipped.com"]))
    return out.select("pos", "reason", "domain", "year", "month")


# Loads.


@query("resumed_load", "SELECT event_id, event_type, user_id, value FROM events")
def resumed_load(spark, d):
    """Events that land in five files, with repeated rows, loaded as a stream whose second batch fails after it was written and is run again."""
    src, out, state = folder(spark), folder(spark), folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    for n in range(5):
        e.filter(f"event_id % 5 = {n} or event_id % 10 = 0 and {n} > 0").coalesce(4).write.mode("append").parquet(src)
    tries = []

    def put(batch, path):
        batch.write.mode("overwrite").parquet(path)
        tries.append(path)
        if len(tries) == 2:
            raise RuntimeError("the second batch is lost once")

    start = lambda: incremental.append_unseen(incremental.stream(spark, src, e.schema, 2), out, state, "event_id", write=put)
    try:
        start().awaitTermination()
    except Exception as error:  # noqa: BLE001  of the stream
        if "lost once" not in str(error):
            raise
        start().awaitTermination()
    return incremental.loaded(spark, out)


@query("institutions", "SELECT s_suppkey AS id_institucion, s_name AS nombre_institucion, 'A' || CAST(s_suppkey AS VARCHAR) AS acronym, CAST(s_nationkey AS BIGINT) AS id_tipo FROM supplier")
def institutions(spark, d):
    """Landed JSON lists, some of them twice, with entries without an id."""
    s = table(spark, d, "supplier").select(F.struct(F.col("s_suppkey").alias("id_institucion"), F.col("s_name").alias("nombre_institucion"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string")).alias("acronym"), F.col("s_nationkey").cast("long").alias("id_tipo"), F.lit("x").alias("more")).alias("r"), "s_nationkey")
    lists = s.groupBy("s_nationkey").agg(F.to_json(F.collect_list("r")).alias("payload")).select(F.regexp_replace("payload", r"\]$", ',{"nombre_institucion":"none"}]').alias("payload"))
    return S.institutions(lists.unionAll(lists.filter("length(payload) % 2 = 0")), "payload")


@query("optional_join", "SELECT doc_id, quality, 1 AS part FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, NULL, 2 FROM documents")
def optional_join(spark, d):
    """With the optional table, and without it."""
    docs = table(spark, d, "documents").select("doc_id")
    a = lookup.enrich(docs, table(spark, d, "labels").select("doc_id", "quality"), "doc_id").withColumn("part", F.lit(1))
    return a.unionByName(lookup.enrich(docs, None, "doc_id").withColumns({"quality": F.lit(None).cast("bigint"), "part": F.lit(2)}))


@query("date_cascade", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2021-05-06' WHEN 1 THEN '2020-03-04' WHEN 2 THEN '2019-07-15' END AS day, CASE page_id % 4 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'page' WHEN 2 THEN 'url' END AS origin FROM pages""")
def date_cascade(spark, d):
    """The sitemap's date, else the page's (by its own cascade), else the URL's."""
    k = F.col("page_id") % 4
    lastmod = F.when(k == 0, "2021-05-06T10:00:00Z").when(k == 1, "no date").otherwise("")
    html = F.when(k <= 1, "<script type='application/ld+json'>{\"dateCreated\": \"2020-03-04\"}</script>").otherwise("<p>x</p>")
    url = F.when(k <= 2, "http://a.org/2019/07/x").otherwise("http://a.org/x")
    options = {"sitemap": D.flexible(lastmod), "page": D.flexible(H.date_text(html)), "url": D.of_url(url)}
    found_in = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in options.items()])
    return table(spark, d, "pages").select("page_id", D.resolve(*options.values()).cast("string").alias("day"), found_in.alias("origin"))


# Pages.


@query("html_json_ld", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'g' || page_id WHEN 1 THEN 'l "' || page_id || '" é' WHEN 2 THEN 'second' WHEN 3 THEN 'own' END AS published,
CASE page_id % 6 WHEN 0 THEN page_id WHEN 4 THEN 1500 END AS likes, CASE page_id % 6 WHEN 3 THEN 7 WHEN 4 THEN page_id END AS comments FROM pages""")
def html_json_ld(spark, d):
    """Structured data in graphs, lists, with escapes, broken scripts, and the same words inside texts."""
    n = F.col("page_id").cast("string")
    script = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</script>"))
    planted = F.array(
        script('{"@graph": [{"@type": "WebSite"}, {"datePublished": "g', n, '", "interactionStatistic": [{"interactionType": {"@type": "LikeAction"}, "userInteractionCount": ', n, "}]}]}"),
        script('[{"a": 1}, {"datePublished": "l \\"', n, '\\" \\u00e9"}]'),
        F.concat(script('{"datePublished": "broken'), script('{"datePublished": "second"}')),
        script('{"text": "\\"datePublished\\": \\"no\\"", "datePublished": "own", "commentCount": "7"}'),
        script('{"@graph": [{"interactionStatistic": [{"interactionType": "http://schema.org/LikeAction", "userInteractionCount": "1.5K"}, {"interactionType": "CommentAction", "userInteractionCount": ', n, "}]}]}"),
        F.lit('<script>{"datePublished": "of another script", "commentCount": 3}</script>'),
    )
    html = F.get(planted, (F.col("page_id") % 6).cast("int"))
    e = H.engagement(html)
    return table(spark, d, "pages").select("page_id", H.json_value(html, "datePublished").alias("published"), e["like_count"].cast("long").alias("likes"), e["comment_count"].cast("long").alias("comments"))


@query("composed_texts", "SELECT doc_id, sha256(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS text_sha256 FROM documents")
def composed_texts(spark, d):
    """Letters that came with a separate accent, put together, and control characters dropped."""
    bounded_batches(spark)
    return table(spark, d, "documents").select("doc_id", F.sha2(H.nfc(X.drop_controls(F.concat(F.lit("\u0007"), F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u007f")))), 256).alias("text_sha256"))
