"""Queries on landed files (written from the tables, read back), on texts with planted phrases, and whole analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import dates as D
from ..functions import text as X
from ..functions import urls as U
from ..operators import posts as P
from ..operators import scratch, terms
from ..sources import tables as S
from . import analyses
from .base import A, CAL, STOP, WORDS, articles, calendar, listed, query, r6, table
from .vocabulary import STRIPPED


def folder(spark) -> str:
    return scratch.folder(spark, "landed")


# Sources and sinks.


@query("csv_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS text_sha256, CASE WHEN doc_id % 3 = 0 THEN 'a \"quoted\", ' || chr(10) || ' field' ELSE 'plain' END AS note FROM documents")
def csv_round_trip(spark, d):
    path = folder(spark)
    note = F.when(F.col("doc_id") % 3 == 0, F.lit('a "quoted", \n field')).otherwise("plain")
    S.write_csv(table(spark, d, "documents").withColumn("note", note), path, ["doc_id", "text", "note"])
    got = S.csv_rows(spark, path, ["doc_id", "text", "note"])
    return got.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "note")


@query("csv_append_typed", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, date_trunc('day', o_orderdate) AS day, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, o_orderkey % 2 = 0 AS even FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT CAST(o_orderkey AS BIGINT), NULL, CAST(o_orderkey * 1000 AS DOUBLE), false FROM orders WHERE o_orderkey % 2 = 1")
def csv_append_typed(spark, d):
    path, columns, k = folder(spark), ["o_orderkey", "day", "price", "even"], F.col("o_orderkey")
    o = table(spark, d, "orders")
    price = F.when(k % 4 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    S.write_csv(o.filter(k % 2 == 0).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), price.alias("price"), F.lit("True").alias("even")), path, columns)
    S.write_csv(o.filter(k % 2 == 1).select("o_orderkey", F.lit("no date").alias("day"), F.format_number(k * 1000, 0).alias("price"), F.lit("no").alias("even")), path, columns, append=True)
    got = S.typed(S.csv_rows(spark, path, columns), {"day": "yyyy-MM-dd"}, ("price",), ("even",))
    return got.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "day", "price", "even")


@query("labelled_load", f"WITH {A} SELECT doc_id AS pos, source || '.example.org' AS domain, title, CAST(len({WORDS}) AS INTEGER) AS word_count, 'landed' AS source_file, 2 AS src_priority FROM (SELECT *  REPLACE (trim(title, ' ') AS title) FROM a)")
def labelled_load(spark, d):
    a = articles(spark, d).withColumns({"domain": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("www."), "source", F.lit(".example.org"))).otherwise(""), "word_count": F.size(X.words(F.col("text"))).cast("string"), "year": F.lit("2021"), "month": F.lit(" 05 ")})
    raw = S.renamed(a.withColumnsRenamed({"text": "content"}), {"content": "text"}).withColumn("title", F.concat(F.lit("  "), F.trim("title"), F.lit(" ")))
    return S.labelled(raw, "landed", 2).select("pos", "domain", "title", F.col("word_count").cast("int").alias("word_count"), "source_file", "src_priority")


@query("hub_load", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE source END AS source FROM documents WHERE lang IN ('en', 'fr') AND len({WORDS}) >= 30")
def hub_load(spark, d):
    docs = table(spark, d, "documents").withColumn("kind", F.concat(F.lit(" "), F.upper("lang")))
    return S.hub(docs, F.col("kind"), ["en", "fr"], "text", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source"))).select("doc_id", "source")


@query("url_column", "SELECT page_id, url AS found FROM pages")
def url_column(spark, d):
    p = table(spark, d, "pages").withColumnRenamed("url", "article_url")
    return p.select("page_id", F.col(S.url_column(p.columns)).alias("found"))


@query("sitemap_scan", "SELECT url AS loc, '2021-05-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS lastmod FROM pages")
def sitemap_scan(spark, d):
    """Sitemaps of a hundred pages each, read as files."""
    path = folder(spark)
    day = F.concat(F.lit("2021-05-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    entries = table(spark, d, "pages").select(F.expr("page_id div 100").alias("k"), F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>")).alias("e"))
    entries.groupBy("k").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("e"), "\n"), F.lit("</urlset>")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)  # a document a file
    return S.sitemap(spark, path).select("loc", F.col("lastmod").cast("string").alias("lastmod"))


@query("sitemap_tree", """WITH RECURSIVE j AS (SELECT url, page_id % 3 AS kind, CAST(page_id // 25 AS VARCHAR) AS leaf, CAST(page_id // 100 AS VARCHAR) AS k FROM pages),
edges AS (SELECT 'root' AS parent, 'index-' || k AS child FROM j UNION SELECT 'root', 'root' UNION SELECT 'index-' || k, 'leaf-' || leaf FROM j UNION SELECT 'index-' || k, 'root' FROM j UNION SELECT 'index-' || k, 'side-' || k FROM j
  UNION SELECT 'side-' || k, unnest(['deep-' || k, 'index-' || k, 'over-' || k]) FROM j UNION SELECT 'over-' || k, 'gone-' || k FROM j),
way AS (SELECT 'root' AS sitemap, 0 AS depth UNION SELECT child, depth + 1 FROM way JOIN edges ON parent = sitemap WHERE depth < 3),
least AS (SELECT sitemap, min(depth) AS depth FROM way GROUP BY sitemap),
urls AS (SELECT CASE kind WHEN 0 THEN 'leaf-' || leaf WHEN 1 THEN 'deep-' || k ELSE 'gone-' || k END AS sitemap, url AS loc FROM j)
SELECT sitemap, CAST(depth AS INTEGER) AS depth, loc FROM urls JOIN least USING (sitemap)""")
def sitemap_tree(spark, d):
    """Landed sitemaps three levels below a root, with indexes that name each other and themselves, a fourth level, and names of what was not landed or is no XML."""
    j = table(spark, d, "pages").select("url", (F.col("page_id") % 3).alias("kind"), F.expr("string(page_id div 25)").alias("leaf"), F.expr("string(page_id div 100)").alias("k"))
    name = lambda n, c="k": F.concat(F.lit(f"{n}-"), F.col(c))
    tops = j.select("leaf", "k").distinct()
    edge = lambda a, b: tops.select(a.alias("parent"), b.alias("child"))
    root = F.lit("root")
    edges = [(root, name("index")), (root, root), (name("index"), name("leaf", "leaf")), (name("index"), root), (name("index"), name("side")), (name("index"), name("missing")), (name("index"), name("broken"))]
    edges += [(name("side"), name("deep")), (name("side"), name("index")), (name("side"), name("over")), (name("over"), name("gone"))]
    indexes = reduce(lambda a, b: a.unionAll(b), [edge(*e) for e in edges]).distinct()
    owner = F.when(F.col("kind") == 0, name("leaf", "leaf")).when(F.col("kind") == 1, name("deep")).otherwise(name("gone"))
    document = lambda outer, inner, loc: F.concat(F.lit(f'<?xml version="1.0"?><{outer} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(F.concat(F.lit(f"<{inner}><loc> "), F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{inner}>"))), ""), F.lit(f"</{outer}>"))
    landed = indexes.groupBy(F.col("parent").alias("url")).agg(document("sitemapindex", "sitemap", F.col("child")).alias("xml"))
    landed = landed.unionAll(j.groupBy(owner.alias("url")).agg(document("urlset", "url", F.col("url")).alias("xml"))).unionAll(tops.select(name("broken"), F.lit("<urlset><url><loc>x</urlset>")).distinct())
    path = folder(spark)
    landed.write.parquet(path)
    roots = spark.createDataFrame([("root",)], "url string")
    return S.sitemap_tree(spark.read.parquet(path), roots).select("sitemap", "depth", "loc")


@query("json_append", "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, 'again' FROM documents WHERE doc_id % 7 = 0")
def json_append(spark, d):
    path, docs = folder(spark), table(spark, d, "documents")
    S.append_json(docs.select("doc_id", "lang"), path)
    S.append_json(docs.filter("doc_id % 7 = 0").select("doc_id", F.lit("again").alias("lang")), path)
    return spark.read.schema("doc_id long, lang string").json(path)


@query("pages_cache", "SELECT url, sha256(html) AS html_sha256 FROM pages")
def pages_cache(spark, d):
    path = folder(spark)
    S.pages_cache(table(spark, d, "pages"), "url", "html", path)
    return spark.read.parquet(path).filter("name is not null").select("url", F.sha2("html", 256).alias("html_sha256"))


@query("institution_documents", "SELECT CAST(page_id AS BIGINT) AS id_documents, CAST(2010 + page_id % 15 AS INTEGER) AS year, page_id % 2 = 0 AS has_annex FROM pages WHERE page_id <> 0 AND page_id % 15 >= 5")
def institution_documents(spark, d):
    i = F.col("page_id")
    raw = table(spark, d, "pages").select(i.cast("string").alias("id_documents"), (2010 + i % 15).cast("string").alias("year"), F.col("url").alias("file_url"), F.lit("x").alias("name"), F.lit("1,200").alias("downloads"), F.when(i % 2 == 0, "f.pdf").alias("document_file_name_anexo"))
    return S.documents_of(raw, "http://d.example.org/f.php").select(F.col("id_documents").cast("long").alias("id_documents"), F.col("year").cast("int").alias("year"), "has_annex")


@query("repaired_texts", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'live' ELSE 'archive' END AS repaired_from FROM (SELECT min(page_id) AS page_id FROM pages GROUP BY url) WHERE page_id % 3 = 0 OR page_id % 2 = 0")
def repaired_texts(spark, d):
    p = table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    broken = p.select("page_id", "url", F.lit(None).cast("string").alias("text"))
    live, archive = (p.filter(f"page_id % {k} = 0").select("url", F.lit(str(k)).alias("text")) for k in (3, 2))
    return S.repaired(broken, live, archive).select("page_id", "repaired_from")


@query("cached_vectors", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS first FROM documents")
def cached_vectors(spark, d):
    path, docs = folder(spark), table(spark, d, "documents").select("doc_id", "text")
    make = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("double")))
    S.cached_vectors(spark, docs.filter("doc_id % 2 = 0"), "text", path, make)  # half of them are there the second time
    return S.cached_vectors(spark, docs, "text", path, make).select("doc_id", F.col("embedding")[0].alias("first"))


@query("parsed_posts", """WITH p AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS tweet_id, 'h' AS handle, CAST(2020 + turn AS INTEGER) AS year, substr(replace(replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' '), chr(13), ' '), 1, 1000) AS text, CAST(turn AS BIGINT) AS likes FROM conversations JOIN p USING (conv_id, turn) WHERE conv_id % 5 <> 0""")
def parsed_posts(spark, d):
    c = table(spark, d, "conversations")
    raw = c.select(F.col("conv_id").alias("id"), F.concat(F.when(F.col("conv_id") % 5 == 0, "RT @").otherwise(""), "text").alias("text"), F.concat(F.lit("Mon Jan 01 00:00:00 +0000 "), (2020 + F.col("turn")).cast("string")).alias("createdAt"), F.col("turn").alias("likeCount"),
        *[F.lit(None).cast("long").alias(x) for x in ("retweetCount", "replyCount", "quoteCount", "viewCount")], F.lit("es").alias("lang"), "turn")
    return P.parsed(raw, "h", "a", ("turn",)).select("tweet_id", "handle", "year", "text", "likes")


# Texts with planted phrases: default lists, dates in words, bylines, wrong encodings.

SPANISH = [m for m in L.MONTHS if m != "septbre"]


@query("spoken_dates", f"""WITH m AS (SELECT doc_id, CAST(doc_id % 28 + 1 AS INTEGER) AS day, CAST(doc_id % 12 + 1 AS INTEGER) AS month, CAST(2010 + doc_id % 17 AS INTEGER) AS year FROM documents)
SELECT doc_id, {listed(SPANISH)}[month] AS said, strftime(make_date(year, month, CASE doc_id % 3 WHEN 0 THEN day ELSE 1 END), '%Y-%m-%d') AS day FROM m""")
def spoken_dates(spark, d):
    i = F.col("doc_id")
    month, year = F.array(*map(F.lit, SPANISH))[(i % 12).cast("int")], (2010 + i % 17).cast("string")
    text = F.when(i % 3 == 0, F.concat_ws(" ", F.lit(" Publicado el"), (i % 28 + 1).cast("string"), F.lit("DE"), F.initcap(month), F.lit("de"), year)).when(i % 3 == 1, F.concat_ws(" ", month, year)).otherwise(F.concat_ws(" de ", F.upper(month), year))
    return table(spark, d, "documents").select("doc_id", month.alias("said"), D.flexible(text).cast("string").alias("day"))


KEYWORDS = L.STRONG_KEYWORDS + L.NORMAL_KEYWORDS
EDGE = "(^|[^\\pL\\pN_\\pM]){w}([^\\pL\\pN_\\pM]|$)"
POINTS = " + ".join(f"{p} * CAST(regexp_matches(s, '{EDGE.format(w=w.lower())}') AS INTEGER)" for ws, p in ((L.STRONG_KEYWORDS, 2), (L.NORMAL_KEYWORDS, 1)) for w in ws)


@query("relevance_default", f"WITH {A}, k AS (SELECT *, title || ' ' || {listed(KEYWORDS)}[doc_id % {len(KEYWORDS)} + 1] AS head FROM a), s AS (SELECT doc_id, lower(head || ' ' || substr(text, 1, 1500)) AS s FROM k) SELECT doc_id, CAST({POINTS} AS INTEGER) AS score FROM s")
def relevance_default(spark, d):
    word = F.array(*map(F.lit, KEYWORDS))[(F.col("doc_id") % len(KEYWORDS)).cast("int")]
    return articles(spark, d).select("doc_id", X.relevance(F.concat_ws(" ", "title", word), F.col("text")).alias("score"))


@query("irrelevant_default", f"""WITH {A}, k AS (SELECT doc_id, lower(title || ' ' || {listed(L.IRRELEVANT_KEYWORDS)}[doc_id % {len(L.IRRELEVANT_KEYWORDS)} + 1] || CASE WHEN doc_id % 2 = 0 THEN ' bukele' ELSE '' END) AS t FROM a)
SELECT doc_id, ({" OR ".join(f"regexp_matches(t, '{EDGE.format(w=w.lower())}')" for w in L.IRRELEVANT_KEYWORDS)}) AND NOT ({" OR ".join(f"regexp_matches(t, '{EDGE.format(w=w.lower())}')" for w in L.STRONG_KEYWORDS)}) AS irrelevant FROM k""")
def irrelevant_default(spark, d):
    word = F.array(*map(F.lit, L.IRRELEVANT_KEYWORDS))[(F.col("doc_id") % len(L.IRRELEVANT_KEYWORDS)).cast("int")]
    title = F.concat("title", F.lit(" "), word, F.when(F.col("doc_id") % 2 == 0, " bukele").otherwise(""))
    return articles(spark, d).select("doc_id", X.irrelevant_title(title).alias("irrelevant"))


@query("about_default", "SELECT doc_id, doc_id % 6 IN (1, 2, 3, 5) AS about FROM documents")
def about_default(spark, d):
    planted = ["El Salvador y El Salvador", "El Salvador, el salvador: CECOT", "El Salvador con pandillas, FMLN y arena", "Bukele y Bukele", "Bukele", "el salvador EL SALVADOR El Salvador"]
    text = F.concat_ws(" ", F.translate("text", "aeiou", ""), F.array(*map(F.lit, planted))[(F.col("doc_id") % 6).cast("int")])
    return table(spark, d, "documents").select("doc_id", X.about(text).alias("about"))


@query("curation_clean", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'el año ' || doc_id WHEN 1 THEN 'cuerpo ' || doc_id WHEN 2 THEN 'texto 日本 ' || doc_id ELSE 'primero' || chr(10) || chr(10) || 'segundo ' || doc_id END AS cleaned FROM documents""")
def curation_clean(spark, d):
    i = F.col("doc_id").cast("string")
    planted = [F.concat(F.lit("el aÃ±o "), i), F.concat(F.lit("Titular largo\nPor\nAna Pérez\nhace 2 horas\n12\ncuerpo "), i, F.lit("\ncompartir")), F.concat(F.lit("Nacional\n\ntexto 日本 "), i, F.lit("\nTodos los derechos reservados")), F.concat(F.lit("primero\n\n\n\nsegundo "), i, F.lit("\nVer más notas"))]
    return table(spark, d, "documents").select("doc_id", X.clean_for_curation(F.array(*planted)[(F.col("doc_id") % 4).cast("int")]).alias("cleaned"))


WHOLE = f"list_filter(regexp_extract_all(lower({STRIPPED}), '[\\pL\\pN_\\pM]+'), lambda x: regexp_full_match(x, '[a-záéíóúüñ]{{3,}}') AND NOT list_contains({listed(STOP)}, x))"
PAIRS = f"b AS (SELECT role, w[i] || ' ' || w[i + 1] AS term FROM (SELECT role, w, unnest(range(1, len(w))) AS i FROM (SELECT role, {WHOLE} AS w FROM conversations)))"


@query("analysis_bigrams_top", f"WITH {PAIRS}, c AS (SELECT role AS handle, term, count(*) AS n FROM b WHERE term <> 'th th' GROUP BY ALL) SELECT handle, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 20")
def analysis_bigrams_top(spark, d):
    return _bigrams(spark, d)["accounts_top"].select("handle", "term", "n", "rank")


@query("analysis_bigrams_outlets", f"""WITH {A}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lower(trim(title, ' ')) ORDER BY src_priority, pos) AS k FROM a) WHERE k = 1 OR trim(title, ' ') = ''),
h AS (SELECT source AS role, title || ' ' || substr(text, 1, 1200) AS text FROM o), {PAIRS.replace('FROM conversations', 'FROM h')}, c AS (SELECT role AS domain, term, count(*) AS n FROM b GROUP BY ALL)
SELECT domain, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 20""")
def analysis_bigrams_outlets(spark, d):
    return _bigrams(spark, d)["outlets_top"].select("domain", "term", "n", "rank")


def posts_of(spark, d):
    """Conversations as posts."""
    day = F.date_add(F.lit("2019-01-01").cast("date"), (F.col("conv_id") % 1800).cast("int"))
    return table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("tweet_id"), F.col("role").alias("handle"), day.cast("timestamp").alias("ts"), "text", F.col("turn").alias("likes"))


POSTS = "p AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS tweet_id, role AS handle, DATE '2019-01-01' + CAST(conv_id % 1800 AS INTEGER) AS ts, text, turn AS likes FROM conversations)"


def _bigrams(spark, d):
    a = articles(spark, d).withColumn("domain", F.col("source"))
    return analyses.bigrams(posts_of(spark, d), a, ["user", "assistant", "system"], [f"src{i}" for i in range(1000)], STOP, ["th th"])


@query("analysis_paper_rates", f"""WITH {POSTS}, t AS (SELECT unnest(['the', 'que', 'der ']) AS term) SELECT term, CAST(year(ts) AS INTEGER) AS year, count(*) AS rows, round(1000.0 * avg(CASE WHEN contains(lower(text), term) THEN 1 ELSE 0 END), 6) + 0.0 AS rate FROM p, t GROUP BY ALL""")
def analysis_paper_rates(spark, d):
    out = analyses.tables_of_paper(posts_of(spark, d), ["the", "que", "der "], F.col("handle") == "system", "user", "2021-01-01", STOP)
    return out["rates"].withColumn("rate", r6(F.col("rate"))).select("term", "year", "rows", "rate")


@query("analysis_paper_ratios", f"""WITH {POSTS}, t AS (SELECT unnest(['the', 'que', 'der ']) AS term), h AS (SELECT term, handle = 'system' AS own, CASE WHEN contains(lower(text), term) THEN 1 ELSE 0 END AS h FROM p, t)
SELECT term, round(avg(CASE WHEN own THEN h END) / nullif(avg(CASE WHEN NOT own THEN h END), 0), 6) + 0.0 AS ratio FROM h GROUP BY term""")
def analysis_paper_ratios(spark, d):
    out = analyses.tables_of_paper(posts_of(spark, d), ["the", "que", "der "], F.col("handle") == "system", "user", "2021-01-01", STOP)
    return out["ratios"].withColumn("ratio", r6(F.col("ratio")))


TARGETS = {"press": [r"\bthe\b"], "court": ["ción", "los "]}
STRATEGIES = {"insult": ["ing"], "accuse": [r"\?", "!!"]}


def _critics(spark, d):
    return analyses.critics(posts_of(spark, d), TARGETS, STRATEGIES, "2022-06-30")


MARKED = f"""{POSTS}, x AS (SELECT *, list_filter([CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'press' END, CASE WHEN regexp_matches(lower(text), 'ción|los ') THEN 'court' END], lambda x: x IS NOT NULL) AS targets,
 list_filter([CASE WHEN contains(lower(text), 'ing') THEN 'insult' END, CASE WHEN regexp_matches(text, '\\?|!!') THEN 'accuse' END], lambda x: x IS NOT NULL) AS strategies FROM p WHERE ts <= DATE '2022-06-30'), o AS (SELECT * FROM x WHERE len(targets) > 0 OR len(strategies) > 0)"""


@query("analysis_critics_matrix", f"""WITH {MARKED}, y AS (SELECT unnest(CASE WHEN len(targets) = 0 THEN ['(no specific target)'] ELSE targets END) AS label_a, strategies FROM o), z AS (SELECT label_a, unnest(CASE WHEN len(strategies) = 0 THEN ['(no specific strategy)'] ELSE strategies END) AS label_b FROM y)
SELECT label_b, label_a, count(*) AS n FROM z GROUP BY ALL""")
def analysis_critics_matrix(spark, d):
    return _critics(spark, d)["matrix"]


@query("analysis_critics_tagged", f"WITH {MARKED} SELECT tweet_id, array_to_string(targets, '|') AS targets, array_to_string(strategies, '|') AS strategies FROM o")
def analysis_critics_tagged(spark, d):
    return _critics(spark, d)["tagged"].select("tweet_id", "targets", "strategies")


@query("analysis_critics_months", f"WITH {MARKED}, s AS (SELECT strftime(ts, '%Y-%m') AS ym, unnest(strategies) AS strategy FROM o) SELECT ym, strategy, count(*) AS n FROM s GROUP BY ALL")
def analysis_critics_months(spark, d):
    return _critics(spark, d)["by_month"]


@query("analysis_outlet_heat")
def analysis_outlet_heat(spark, d):
    """Put together of parts that have SQL of their own (tokens, heat)."""
    a = articles(spark, d).withColumns({"domain": F.col("source"), "day": F.col("pub")})
    return analyses.outlet_vocabulary(a, [f"src{i}" for i in range(1000)], STOP, ["the"])["heat"]


@query("analysis_post_words", f"""WITH {POSTS}, t AS (SELECT handle, unnest(list_filter(regexp_extract_all(lower({STRIPPED}), '[a-zà-ÿ]{{3,}}'), lambda x: NOT list_contains({listed(STOP)}, x))) AS term FROM p)
SELECT handle, term, count(*) AS n FROM t GROUP BY ALL""")
def analysis_post_words(spark, d):
    """Counts under the first analysis; its scores are those of distinctive_words."""
    return terms.counts(posts_of(spark, d), X.tokens(F.col("text"), STOP, [], []), "handle")


@query("analysis_releases_volume", f"WITH {A}, {CAL} SELECT strftime(pub, '%Y-%m') AS ym, count(*) AS n FROM a WHERE text <> '' GROUP BY ym")
def analysis_releases_volume(spark, d):
    out = analyses.releases(_releases(spark, d), calendar(spark), {"of": ["of the"]}, ["the", "and"], ["Bukele"])
    return out["volume"].select("ym", "n")


@query("analysis_releases_busiest", f"WITH {A} SELECT strftime(pub, '%Y-%m') AS ym, count(*) AS n FROM a WHERE text <> '' GROUP BY ym ORDER BY n DESC, ym LIMIT 5")
def analysis_releases_busiest(spark, d):
    return analyses.releases(_releases(spark, d), calendar(spark), {"of": ["of the"]}, ["the", "and"])["busiest"].select("ym", "n")


def _releases(spark, d):
    return articles(spark, d).withColumns({"day": F.col("pub"), "word_count": F.size(X.words(F.col("text"))).cast("double"), "days_from_event": F.lit(0.0), "mentions": X.hits(F.col("text"), ["the"]), "named_entities": F.lit("['Bukele']")})


POLLS = "(SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 2 END AS half FROM orders)"


@query("analysis_public_merged", f"""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, median(o_totalprice) AS approval, median(half) AS disapproval FROM {POLLS} GROUP BY ym)
SELECT ym, round(approval, 4) AS approval, round(disapproval, 4) AS disapproval, CASE CAST(substr(ym, 1, 4) AS INTEGER) WHEN 1996 THEN 61 WHEN 1997 THEN 57 END AS overall, CASE WHEN ym = '1996-05' THEN 70 END AS support FROM m""")
def analysis_public_merged(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("approval"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 2).alias("disapproval"))
    scores = spark.createDataFrame([(1996, 61), (1997, 57)], "year int, overall int")
    questions = spark.createDataFrame([(1996, "A1", 3), (1996, "B2", 4)], "year int, question string, score int")
    crackdown = spark.createDataFrame([(1996, 5, 70)], "year int, month int, support int")
    merged = analyses.public_metrics(scores, o, questions, crackdown)["merged"]
    return merged.select("ym", F.round("approval", 4).alias("approval"), F.round("disapproval", 4).alias("disapproval"), "overall", "support")


@query("event_export_rules", "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'no_url' WHEN contains(url, '.com') THEN 'geo' ELSE 'kept' END AS reason FROM pages")
def event_export_rules(spark, d):
    """A landed export, read as it comes, each row with the first rule that drops it."""
    path = folder(spark)
    p = table(spark, d, "pages").withColumn("article_url", F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("url")))
    S.write_csv(p, path, ["page_id", "article_url"])
    got = S.csv_rows(spark, path, ["page_id", "article_url"])
    u = F.coalesce("article_url", F.lit(""))
    return got.select(F.col("page_id").cast("long").alias("page_id"), U.rule_chain([(u == "", "no_url"), (F.contains(u, F.lit(".com")), "geo")]).alias("reason"))
