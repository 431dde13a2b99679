"""Queries on rows to keep: deduplication, gates, URL and date rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import dates as D
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..llm.common import bounded_batches
from ..operators import classify, dedup, lookup
from .base import A, WORDS, articles, query, table



def order():
    return [F.col("src_priority"), F.col("pos")]


FIRST = "SELECT {c} FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY src_priority, pos) AS k FROM {t}) WHERE k = 1"


@query("dedup_url_priority", f"WITH {A} " + FIRST.format(c="doc_id, url, src_priority", k="url", t="a WHERE url <> ''"))
def dedup_url_priority(spark, d):
    return dedup.by_url(articles(spark, d)).select("doc_id", "url", "src_priority")


@query("dedup_first", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def dedup_first(spark, d):
    return dedup.first(table(spark, d, "events"), [F.col("user_id")], [F.col("event_id")]).select("user_id", "event_id")


KEYED = "k AS (SELECT *, substr(regexp_replace(lower(title), '[^a-záéíóúñü0-9]', '', 'g'), 1, 120) AS key FROM a)"


@query("dedup_title_norm", f"WITH {A}, {KEYED} SELECT doc_id, key, length(key) > 15 AND row_number() OVER (PARTITION BY key ORDER BY src_priority, pos) > 1 AS title_repeats FROM k")
def dedup_title_norm(spark, d):
    keyed = articles(spark, d).withColumn("key", X.title_key(F.col("title")))
    return dedup.mark_title(keyed, F.col("key"), ["src_priority", "pos"]).select("doc_id", "key", "title_repeats")


@query("dedup_cascade", f"WITH {A}, u AS ({FIRST.format(c='*', k='url', t='a')}) SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY src_priority, pos) AS j FROM u) WHERE j = 1 OR title = ''")
def dedup_cascade(spark, d):
    return dedup.cascade(articles(spark, d), F.col("url"), F.lower("title"), order()).select("doc_id")


@query("dedup_domain_title", f"WITH {A} SELECT doc_id FROM (SELECT doc_id, title, row_number() OVER (PARTITION BY source, lower(trim(title, ' ')) ORDER BY src_priority, pos) AS j FROM a) WHERE j = 1 OR trim(title, ' ') = ''")
def dedup_domain_title(spark, d):
    return dedup.by_domain_title(articles(spark, d), "source", "title", order()).select("doc_id")


#: Row by row, with a list of the keys that are taken.
GREEDY = f"""WITH RECURSIVE {A}, k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS i, doc_id, list_filter([CASE WHEN doc_id % 5 = 0 THEN hash('u:' || regexp_replace(url, '/+$', '')) END,
 hash('f:' || sha256(substr(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 2000))), CASE WHEN title <> '' THEN hash('k:' || source || chr(1) || title || chr(1) || CAST(pub AS VARCHAR)) END], lambda x: x IS NOT NULL) AS keys FROM a),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS UBIGINT[]) AS seen, CAST(NULL AS BIGINT) AS kept
 UNION ALL SELECT k.i, CASE WHEN list_has_any(seen, keys) THEN seen ELSE list_concat(seen, keys) END, CASE WHEN NOT list_has_any(seen, keys) THEN doc_id END FROM walk JOIN k ON k.i = walk.i + 1)
SELECT kept AS doc_id FROM walk WHERE kept IS NOT NULL"""


@query("dedup_greedy", GREEDY)
def dedup_greedy(spark, d):
    """Depends on what was kept before."""
    a = articles(spark, d).withColumn("url", F.when(F.col("doc_id") % 5 == 0, F.col("url")).otherwise(F.lit("")))
    return dedup.greedy(a, "url", "text", "source", "title", "pub").select("doc_id")


@query("fingerprint", "SELECT doc_id, sha256(substr(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 2000)) AS fp FROM documents")
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fp"))


# Footers and headers are cut by the same expressions in RE2; the byline block is not found in these texts.
CLEANED = "regexp_replace(text, '^\\s*[A-ZÁÉÍÓÚÑ][^\\n]{0,40}\\n\\n', '')"
for _p in (r"\n(compartir|share)\s*$", r"\n(suscr[ií]bete|subscribe)[^\n]*$", "©", r"\ntodos los derechos reservados", r"\n(cookies?|privacidad|privacy)[^\n]*$", r"\n(ver m[aá]s|read more|continue reading)[^\n]*$", r"\nir al inicio[^\n]*$"):
    CLEANED = f"regexp_replace({CLEANED}, '{_p}', '', 'gi')"
CLEANED = f"regexp_replace(regexp_replace({CLEANED}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
CURATED = f"""e AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY src_priority, pos) AS u, len({WORDS}) AS w, len({WORDS.replace('(text,', f'({CLEANED},')}) AS wc,
   regexp_matches(lower(title || ' ' || substr(text, 1, 300)), '{L.ERROR_PAGE}') AS err, substr(regexp_replace(lower(title), '[^a-záéíóúñü0-9]', '', 'g'), 1, 120) AS key FROM a),
 g AS (SELECT *, CASE WHEN u > 1 THEN 'url' WHEN source = 'src3' THEN 'domain' WHEN err THEN 'error' WHEN w < 50 THEN 'short' END AS early FROM e),
 h AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN early IS NULL THEN key END ORDER BY src_priority, pos) AS t FROM g),
 c AS (SELECT doc_id, CASE WHEN early IS NOT NULL THEN early WHEN length(key) > 15 AND t > 1 THEN 'title' WHEN wc < 50 THEN 'short_clean' ELSE 'kept' END AS reject_reason FROM h)"""


def _curated(spark, d):
    return dedup.curate(articles(spark, d).withColumn("domain", F.col("source")), ["src3"])


@query("curate", f"WITH {A}, {CURATED} SELECT * FROM c")
def curate(spark, d):
    return _curated(spark, d).select("doc_id", "reject_reason")


@query("reject_audit", f"WITH {A}, {CURATED} SELECT reject_reason, count(*) AS rows FROM c GROUP BY ALL")
def reject_audit(spark, d):
    return dedup.audit(_curated(spark, d))


@query("union_priority", f"WITH {A} SELECT 'one' AS source_file, count(*) AS n FROM a WHERE doc_id % 2 = 0 UNION ALL SELECT 'two', count(*) FROM a WHERE doc_id % 4 <> 0")
def union_priority(spark, d):
    a = articles(spark, d)
    both = dedup.union((a.filter("doc_id % 2 = 0"), "one", 0), (a.filter("doc_id % 4 <> 0").drop("lang"), "two", 1))
    return both.groupBy("source_file").agg(F.count("*").alias("n"))


@query("set_ops", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS without_label, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS with_label, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS either_table")
def set_ops(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    one = [(a.subtract(b), "without_label"), (a.intersect(b), "with_label"), (a.union(b).distinct(), "either_table")]
    out = None
    for df, name in one:
        n = df.agg(F.count("*").alias(name))
        out = n if out is None else out.join(F.broadcast(n))  # single rows
    return out


HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
CUT = "regexp_replace(url, '[?#].*$', '')"
SLUG = f"lower(translate(regexp_replace({CUT}, '^https?://[^/]+', ''), '-_/', '   '))"


def _has(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


@query("url_domain", f"SELECT page_id, lower(regexp_replace({HOST}, '^www\\.', '')) AS domain, {PATH} AS path, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?&]utm_\\w+=[^&]*', '', 'g'), '/+$', '') AS normal FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", U.domain(F.lit(""), F.col("url")).alias("domain"), U.path(F.col("url")).alias("path"), U.normalise(F.col("url")).alias("normal"))


@query("url_rules", f"""SELECT page_id, length(url) >= 20 AND NOT regexp_matches(url, '{"|".join(L.SKIP_URL)}', 'i') AS article, regexp_matches(url, '/(es|fr)/', 'i') AS bad_section,
CASE WHEN list_has_any(regexp_split_to_array(lower({PATH}), '[/\\-_]'), ['de', 'fr']) THEN false WHEN list_has_any(regexp_split_to_array(lower({PATH}), '[/\\-_]'), ['en']) THEN true END AS relevant FROM pages""")
def url_rules(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.article(u).alias("article"), U.rejected_section(u, ["es", "fr"]).alias("bad_section"), U.relevance(u, ["de", "fr"], ["en"]).alias("relevant"))


DATED = """u AS (SELECT page_id, 'http://a.example.org' || CASE page_id % 7 WHEN 0 THEN '/2021/06/' || CAST(page_id % 40 AS VARCHAR) || '/x' WHEN 1 THEN '/' || CAST(2008 + page_id % 20 AS VARCHAR) || '/' || CAST(page_id % 15 AS VARCHAR) || '/deportes'
 WHEN 2 THEN '/a-2020-' || lpad(CAST(page_id % 14 AS VARCHAR), 2, '0') || '-11/futbol-bukele' WHEN 3 THEN '/202103' || lpad(CAST(page_id % 33 AS VARCHAR), 2, '0') || '/x' WHEN 4 THEN '/x/' || CAST(1995 + page_id % 40 AS VARCHAR) || '/?q=1'
 WHEN 5 THEN '/recetas/sopa' ELSE '/202203/nota' END AS url FROM pages)"""


def _dated(spark, d):
    v = lambda x: f"CAST({x} AS STRING)"
    return table(spark, d, "pages").selectExpr(
        "page_id",
        f"concat('http://a.example.org', CASE page_id % 7 WHEN 0 THEN concat('/2021/06/', {v('page_id % 40')}, '/x') WHEN 1 THEN concat('/', {v('2008 + page_id % 20')}, '/', {v('page_id % 15')}, '/deportes') "
        f"WHEN 2 THEN concat('/a-2020-', lpad({v('page_id % 14')}, 2, '0'), '-11/futbol-bukele') WHEN 3 THEN concat('/202103', lpad({v('page_id % 33')}, 2, '0'), '/x') WHEN 4 THEN concat('/x/', {v('1995 + page_id % 40')}, '/?q=1') "
        "WHEN 5 THEN '/recetas/sopa' ELSE '/202203/nota' END) AS url",
    )


def _ymd(p, y=1, m=2, dd=3, day=None):
    g = lambda k: f"regexp_extract(url, '{p}', {k})"
    return f"try_strptime({g(y)} || '-' || lpad({g(m)}, 2, '0') || '-' || " + (f"'{day}'" if day else f"lpad({g(dd)}, 2, '0')") + ", '%Y-%m-%d')"


END = f"regexp_extract(regexp_replace({CUT}, '/+$', ''), '/(\\d{{4}})$', 1)"


@query("url_date", f"""WITH {DATED} SELECT page_id, url, strftime(coalesce({_ymd('/(\\d{4})/(\\d{1,2})/(\\d{1,2})/')}, {_ymd('/(\\d{4})/(\\d{1,2})/', day='15')}, {_ymd('(\\d{4})-(\\d{2})-(\\d{2})')}, {_ymd('/(\\d{4})(\\d{2})(\\d{2})/')},
 CASE WHEN TRY_CAST({END} AS INTEGER) BETWEEN 2000 AND 2030 THEN try_strptime({END} || '-06-15', '%Y-%m-%d') END), '%Y-%m-%d') AS day FROM u""")
def url_date(spark, d):
    return _dated(spark, d).withColumn("day", D.of_url(F.col("url")).cast("string"))


def _plausible(p):
    y, m = (f"TRY_CAST(regexp_extract({CUT}, '{p}', {k}) AS INTEGER)" for k in (1, 2))
    return f"CASE WHEN {y} BETWEEN 2000 AND 2030 AND {m} BETWEEN 1 AND 12 THEN {y} END"


YEAR = f"""coalesce({_plausible('/(\\d{4})/(\\d{1,2})/')}, {_plausible('/(\\d{4})(\\d{2})/')}, {_plausible('(\\d{4})-(\\d{2})-\\d{2}')},
 CASE WHEN TRY_CAST(regexp_extract({CUT}, '/(\\d{{4}})\\d{{4}}/', 1) AS INTEGER) BETWEEN 2000 AND 2030 THEN TRY_CAST(regexp_extract({CUT}, '/(\\d{{4}})\\d{{4}}/', 1) AS INTEGER) END, CASE WHEN TRY_CAST({END} AS INTEGER) BETWEEN 2000 AND 2030 THEN TRY_CAST({END} AS INTEGER) END)"""


@query("url_prefilter", f"WITH {DATED}, y AS (SELECT page_id, {YEAR} AS year, {SLUG} AS slug FROM u) SELECT page_id, coalesce(year, -1) AS year, coalesce(year BETWEEN 2015 AND 2025, true) AND NOT ({_has('slug', L.URL_IRRELEVANT)} AND NOT {_has('slug', L.URL_STRONG + L.URL_SECTIONS)}) AS passes FROM y")
def url_prefilter(spark, d):
    return _dated(spark, d).select("page_id", F.coalesce(D.year_of_url(F.col("url")), F.lit(-1)).alias("year"), U.prefilter(F.col("url")).alias("passes"))


GEO = f"""CASE WHEN url = '' THEN 'no_url' WHEN {{host}} LIKE 'spam%' THEN 'domain' WHEN NOT (CASE WHEN page_id % 3 = 0 THEN 'ES' ELSE 'US' END = 'ES' OR ends_with({{host}}, '.org')) THEN 'geo'
 WHEN regexp_matches(url, '/({"|".join(L.SKIP_SECTIONS)})/', 'i') THEN 'section' ELSE 'kept' END"""


@query("geo_rules", f"SELECT page_id, {GEO.format(host=f'lower({HOST})')} AS reason FROM pages")
def geo_rules(spark, d):
    u, host = F.col("url"), F.lower(U.netloc(F.col("url")))
    country = F.when(F.col("page_id") % 3 == 0, "ES").otherwise("US")
    chain = U.rule_chain([(u == "", "no_url"), (F.startswith(host, F.lit("spam")), "domain"), (~((country == "ES") | F.endswith(host, F.lit(".org"))), "geo"), (U.rejected_section(u), "section")])
    return table(spark, d, "pages").select("page_id", chain.alias("reason"))


@query("homepage_redirect", f"WITH h AS (SELECT page_id, regexp_replace(lower({HOST}), '^www\\.', '') AS h, {PATH} AS p FROM pages) SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(p, '/+$', '') <> '' ELSE h <> 'other.example.org' OR (regexp_replace(p, '/+$', '') <> '') END AS redirected FROM h")
def homepage_redirect(spark, d):
    got = F.when(F.col("page_id") % 2 == 0, F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)).otherwise("http://other.example.org/")
    return table(spark, d, "pages").select("page_id", U.homepage_redirect(F.col("url"), got).alias("redirected"))


@query("relevance_score", f"""WITH {A}, s AS (SELECT doc_id, lower(title || ' ' || substr(text, 1, 1500)) AS s FROM a)
SELECT doc_id, CAST(2 * CAST(regexp_matches(s, '(^|[^\\pL\\pN_\\pM])the([^\\pL\\pN_\\pM]|$)') AS INTEGER) + 2 * CAST(regexp_matches(s, '(^|[^\\pL\\pN_\\pM])of the([^\\pL\\pN_\\pM]|$)') AS INTEGER) + CAST(regexp_matches(s, '(^|[^\\pL\\pN_\\pM])que([^\\pL\\pN_\\pM]|$)') AS INTEGER) AS INTEGER) AS score FROM s""")
def relevance_score(spark, d):
    return articles(spark, d).select("doc_id", X.relevance(F.col("title"), F.col("text"), ["the", "of the"], ["que"]).alias("score"))


@query("aboutness", """WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), 'of the')) AS p, len(regexp_extract_all(lower(text), 'with')) AS n, len(regexp_extract_all(text, '(this|from)', 0, 'i')) AS k FROM documents)
SELECT doc_id, p >= 3 OR n >= 2 OR (p >= 2 AND k >= 1) OR (p >= 1 AND k >= 3) AS about FROM c""")
def aboutness(spark, d):
    return table(spark, d, "documents").select("doc_id", X.about(F.col("text"), "of the", "with", "(?i)(this|from)").alias("about"))


@query("irrelevant_title", f"WITH {A} SELECT doc_id, regexp_matches(lower(title), '(^|[^\\pL\\pN_\\pM])(and|los)([^\\pL\\pN_\\pM]|$)') AND NOT regexp_matches(lower(title), '(^|[^\\pL\\pN_\\pM])(the)([^\\pL\\pN_\\pM]|$)') AS irrelevant FROM a")
def irrelevant_title(spark, d):
    return articles(spark, d).select("doc_id", X.irrelevant_title(F.col("title"), ["and", "los"], ["the"]).alias("irrelevant"))


@query("error_pages", f"WITH {A} SELECT doc_id, regexp_matches(lower(title || ' ' || substr(text, 1, 300)), '404|not found|la la|of the') AS error FROM a")
def error_pages(spark, d):
    return articles(spark, d).select("doc_id", X.error_page(F.col("title"), F.col("text"), 300, "404|not found|la la|of the").alias("error"))


@query("length_gates", f"SELECT source, count(*) AS n FROM documents WHERE len({WORDS}) >= 50 AND length(text) >= 150 GROUP BY source")
def length_gates(spark, d):
    return table(spark, d, "documents").filter((F.size(X.words(F.col("text"))) >= 50) & (F.length("text") >= 150)).groupBy("source").agg(F.count("*").alias("n"))


DATES = "x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN strftime(pub, '%Y-%m-%d') WHEN 1 THEN strftime(pub, '%d/%m/%Y') WHEN 2 THEN strftime(pub, '%Y%m%d') WHEN 3 THEN strftime(pub, '%Y/%m') ELSE '' END AS s, pub FROM a)"


def _dates(spark, d):
    f = lambda p: F.date_format("pub", p)
    k = F.col("doc_id") % 5
    return articles(spark, d).withColumn("s", F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("dd/MM/yyyy")).when(k == 2, f("yyyyMMdd")).when(k == 3, f("yyyy/MM")).otherwise(""))


@query("year_month", f"WITH {A}, {DATES} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN strftime(pub, '%Y') WHEN 2 THEN strftime(pub, '%Y') WHEN 3 THEN strftime(pub, '%Y') ELSE '' END AS year, CASE doc_id % 5 WHEN 0 THEN strftime(pub, '%m') WHEN 2 THEN strftime(pub, '%m') WHEN 3 THEN strftime(pub, '%m') ELSE '' END AS month FROM x")
def year_month(spark, d):
    return _dates(spark, d).withColumn("ym", D.year_month(F.col("s"))).select("doc_id", "ym.year", "ym.month")


@query("flexible_date", f"WITH {A}, {DATES} SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN strftime(pub, '%Y-%m-%d') END AS day, CASE WHEN doc_id % 5 IN (0, 1) THEN pub BETWEEN DATE '2020-01-01' AND DATE '2020-12-31' ELSE false END AS in_range FROM x")
def flexible_date(spark, d):
    day = D.flexible(F.col("s"))
    return _dates(spark, d).select("doc_id", day.cast("string").alias("day"), D.in_range(day, "2020-01-01", "2020-12-31").alias("in_range"))


@query("social_time", "SELECT event_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 2 = 0")
def social_time(spark, d):
    text = F.date_format("ts", "'Mon' MMM dd HH:mm:ss '+0000' yyyy")
    return table(spark, d, "events").filter("event_id % 2 = 0").select("event_id", D.social(text).alias("ts"))


@query("parse_counts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id * 1000 WHEN 1 THEN event_id WHEN 2 THEN event_id * 1000 + 500 ELSE -1 END AS n FROM events")
def parse_counts(spark, d):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit("K"))).when(i % 4 == 1, F.concat(F.format_number(i, 0), F.lit(" vistas"))).when(i % 4 == 2, F.concat(i.cast("string"), F.lit(".5k"))).otherwise("n/a")
    return table(spark, d, "events").select("event_id", F.coalesce(X.parse_count(text), F.lit(-1)).alias("n"))


@query("safe_numbers", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS INTEGER) ELSE 0 END AS n, CASE WHEN event_id BETWEEN 1990 AND 2100 THEN CAST(event_id AS INTEGER) ELSE -1 END AS year FROM events")
def safe_numbers(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", X.safe_int(F.when(i % 3 == 0, F.format_number(i, 0)).when(i % 3 == 1, "x")).alias("n"), F.coalesce(X.safe_year(i), F.lit(-1)).alias("year"))


@query("document_urls", "SELECT page_id, 'http://d.example.org/f.php?id=' || to_base64(encode(CAST(page_id AS VARCHAR))) || '&inst=' || CAST(page_id AS VARCHAR) AS file_url, CASE WHEN ends_with(split_part(split_part(url, '?', 1), '#', 1), '.html') THEN 'html' ELSE '' END AS extension FROM pages")
def document_urls(spark, d):
    ext = X.extension(F.col("url"))
    return table(spark, d, "pages").select("page_id", X.document_url(F.col("page_id"), "http://d.example.org/f.php").alias("file_url"), F.when(ext == "html", ext).otherwise("").alias("extension"))


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    return lookup.unseen(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("html_title", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]+>', '', 'g')) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


LINKED = "'<a class=\"x\" href=\"//c.org/p\">c</a><a href=''http://o.org/a?b#c''>o</a><a href=\"mailto:x\">m</a><a href=\"#top\">t</a><a href=\"rel/x\">r</a>'"


@query("html_links", f"""WITH l AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+(?:/.*)?/)', 1) AS folder, list_distinct(regexp_extract_all(html, '<a href="([^"#?]+)', 1)) AS found FROM pages)
SELECT page_id, array_to_string(list_sort(list_concat(list_transform(found, lambda x: root || x), ['http://c.org/p', 'http://o.org/a', CASE WHEN folder = '' THEN root || '/' ELSE folder END || 'rel/x'])), ' ') AS links FROM l""")
def html_links(spark, d):
    more = F.lit(LINKED.strip("'").replace("''", "'"))
    found = H.links(F.concat(more, F.col("html")), F.col("url"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.sort_array(found), " ").alias("links"))


@query("html_dates", """WITH t AS (SELECT page_id, DATE '2020-01-01' + CAST(page_id % 300 AS INTEGER) AS day FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN strftime(day, '%Y-%m-%d') END AS meta_date,
CASE page_id % 5 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%Y-%m-%dT00:00') WHEN 2 THEN strftime(day, '%Y-%m-%d') WHEN 3 THEN strftime(day, '%d/%m/%Y') ELSE CAST(day(day) AS VARCHAR) || ' de mayo de ' || CAST(year(day) AS VARCHAR) END AS found FROM t""")
def html_dates(spark, d):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") % 300).cast("int"))
    iso, k = F.date_format(day, "yyyy-MM-dd"), F.col("page_id") % 5
    planted = (
        F.when(k == 0, F.concat(F.lit("<meta content='"), iso, F.lit("' property='article:published_time'><time datetime='1999-01-01'>")))
        .when(k == 1, F.concat(F.lit('<script type="application/ld+json">{"@type": "x", "datePublished": "'), iso, F.lit('T00:00"}</script>')))
        .when(k == 2, F.concat(F.lit("<time class='x' datetime='"), iso, F.lit("'>")))
        .when(k == 3, F.concat(F.lit("<p>el "), F.date_format(day, "dd/MM/yyyy"), F.lit("</p>")))
        .otherwise(F.concat(F.lit("<p>"), F.date_format(day, "d"), F.lit(" de mayo de "), F.date_format(day, "yyyy"), F.lit("</p>")))
    )
    html = F.concat(planted, F.col("html"))
    return table(spark, d, "pages").select("page_id", H.meta(html, "article:published_time").alias("meta_date"), H.date_text(html).alias("found"))


@query("html_article")
def html_article(spark, d):
    """Needs a parser; tested on small pages."""
    bounded_batches(spark)
    return table(spark, d, "pages").select("page_id", H.texts_of("html").alias("t")).select("page_id", "t.content", "t.page")


@query("html_engagement", """SELECT page_id, CASE WHEN page_id % 6 <> 5 THEN page_id END AS comment_count, page_id * 1000 AS share_count, CASE page_id % 3 WHEN 0 THEN page_id * 1000 + 500 WHEN 1 THEN page_id END AS like_count,
CASE WHEN page_id % 2 = 0 THEN page_id END AS view_count FROM pages""")
def html_engagement(spark, d):
    n, k = F.col("page_id").cast("string"), F.col("page_id")
    around = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    comment = F.element_at(
        F.array(
            around("<a class='x comments-count' href='#'>", "</a>"), around("<span class='comments'>", " comentarios</span>"), around("<a class='comments-link' href='#'><b>see</b><span>", "</span></a>"),
            around("<i class='fb-comments-count'>", "</i>"), around('<script type="application/ld+json">{"@type": "Article", "commentCount": "', '"}</script><i class="num-comments">9</i>'), F.lit("<i class='comments-counted'>8</i>"),
        ),
        (k % 6 + 1).cast("int"),
    )
    like = F.when(k % 3 == 0, around('<span data-testid="like_count">', ".5K</span>")).when(k % 3 == 1, around("<b class='fb-like-count'>", "</b>")).otherwise("")
    view = F.when(k % 2 == 0, around('<p class="post-views y">', " vistas</p>")).otherwise("<p class='post-viewsx'>7</p>")
    e = H.engagement(F.concat(comment, around("<i data-shares='", "K'></i>"), like, view, F.col("html")))
    return table(spark, d, "pages").withColumn("e", e).select("page_id", "e.comment_count", "e.share_count", "e.like_count", "e.view_count")


@query("boilerplate_phrases", "SELECT doc_id, length(replace(replace(text, 'the ', ''), 'que ', '')) AS left_chars FROM documents")
def boilerplate_phrases(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.strip_boilerplate(F.col("text"), ["the ", "que "])).cast("long").alias("left_chars"))


LABELS = {"English": [r"\bthe\b", "ing"], "Spanish": [r"ción", "los "], "Loud": [r"!!"]}
LABELLED = "l AS (SELECT doc_id, source, text, n_chars, list_filter([CASE WHEN regexp_matches(lower(text), '\\bthe\\b|ing') THEN 'English' END, CASE WHEN regexp_matches(lower(text), 'ción|los ') THEN 'Spanish' END, CASE WHEN contains(text, '!!') THEN 'Loud' END], lambda x: x IS NOT NULL) AS labels, list_filter([CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '@') THEN 'mail' END], lambda x: x IS NOT NULL) AS marks FROM documents)"


def _labelled(spark, d):
    marks = {"table": [r"\|"], "mail": ["@"]}
    return table(spark, d, "documents").withColumns({"labels": classify.labels(F.col("text"), LABELS), "marks": classify.labels(F.col("text"), marks)})


@query("label_multi", f"WITH {LABELLED} SELECT doc_id, array_to_string(labels, '|') AS labels FROM l")
def label_multi(spark, d):
    return _labelled(spark, d).select("doc_id", F.array_join("labels", "|").alias("labels"))


@query("label_counts", f"WITH {LABELLED} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM l) GROUP BY label")
def label_counts(spark, d):
    return classify.label_counts(_labelled(spark, d), "labels")


@query("label_cross", f"""WITH {LABELLED}, x AS (SELECT doc_id, unnest(CASE WHEN len(labels) = 0 THEN ['(none)'] ELSE labels END) AS label_a, marks FROM l), y AS (SELECT doc_id, label_a, unnest(CASE WHEN len(marks) = 0 THEN ['(no mark)'] ELSE marks END) AS label_b FROM x)
SELECT label_a, label_b, count(*) AS n FROM y GROUP BY ALL""")
def label_cross(spark, d):
    return classify.cross(_labelled(spark, d), "labels", "marks", "(none)", "(no mark)").groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


@query("examples_first_mid_last", f"""WITH {LABELLED}, x AS (SELECT doc_id, unnest(labels) AS label FROM l), y AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM x)
SELECT label, doc_id, CASE WHEN i = 0 THEN 'first' WHEN i = n // 2 THEN 'middle' ELSE 'last' END AS which FROM y WHERE i = 0 OR i = n // 2 OR i = n - 1""")
def examples_first_mid_last(spark, d):
    each = _labelled(spark, d).select("doc_id", F.explode("labels").alias("label"))
    return classify.examples(each, "label", ["doc_id"])


@query("nested_lookup", f"""WITH {LABELLED}, x AS (SELECT unnest(CASE WHEN len(labels) = 0 THEN ['(none)'] ELSE labels END) AS label_a, marks, n_chars, substr(text, 1, 20) AS head FROM l),
y AS (SELECT label_a, unnest(CASE WHEN len(marks) = 0 THEN ['(no mark)'] ELSE marks END) AS label_b, n_chars, head FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY label_a, label_b ORDER BY n_chars DESC, head) AS k FROM y),
o AS (SELECT label_a, label_b, to_json(list(head ORDER BY n_chars DESC, head)) AS texts FROM r WHERE k <= 5 GROUP BY ALL)
SELECT label_a, '{{' || string_agg(to_json(label_b) || ':' || texts, ',' ORDER BY label_b) || '}}' AS lookup FROM o GROUP BY label_a""")
def nested_lookup(spark, d):
    each = classify.cross(_labelled(spark, d), "labels", "marks", "(none)", "(no mark)").withColumn("head", F.substring("text", 1, 20))
    return classify.nested(each, "label_a", "label_b", "n_chars", "head", 5)
