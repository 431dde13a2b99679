"""Queries on words: counts, distinctive terms, similarity, rates, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import posts, series, terms, topics
from .base import A, FOREIGN, STOP, T, THEMES, TOKENS, WORDS, articles, listed, query, r6, table

# Phrases of the supplied texts.
PAIRS = [(r"of\s+the", "of_the"), (r"de\s+la", "de_la")]


def tokens():
    return X.tokens(F.col("text"), STOP, [], [])


LOG_ODDS = """ln(least(greatest(({c} + 0.5) / ({t} + 0.5), 1e-9), 1 - 1e-9) / (1 - least(greatest(({c} + 0.5) / ({t} + 0.5), 1e-9), 1 - 1e-9)))"""
SCORED = f"""tot AS (SELECT source, sum(n) AS total FROM c GROUP BY source), al AS (SELECT sum(n) AS grand FROM c), w AS (SELECT term, sum(n) AS everywhere FROM c GROUP BY term),
s AS (SELECT c.source, c.term, n, {LOG_ODDS.format(c='n', t='total')} - {LOG_ODDS.format(c='(everywhere - n)', t='(grand - total)')} AS score
  FROM c JOIN tot USING (source) JOIN w USING (term), al WHERE n >= {{least}}),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term) AS rank FROM s)
SELECT source, term, CAST(n AS BIGINT) AS n, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""


# Corpora that are tagged with handles and tags lose them before words are found; RE2 and Java agree on these classes.
STRIPPED = "regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', ' ', 'g'), '@[\\pL\\pN_\\pM]+', ' ', 'g'), '#[\\pL\\pN_\\pM]+', ' ', 'g')"
CLEAN_T = T.replace("lower(text)", f"lower({STRIPPED})")


@query("distinctive_words", f"WITH {A}, {CLEAN_T}, c AS (SELECT source, term, count(*) AS n FROM t GROUP BY ALL), {SCORED.format(least=8)}")
def distinctive_words(spark, d):
    out = terms.distinctive(terms.counts(articles(spark, d), tokens(), "source"), "source", 8, 20)
    return out.withColumn("score", r6(F.col("score")))


@query("tok_counts", f"WITH {A}, {CLEAN_T} SELECT source, term, count(*) AS n FROM t GROUP BY ALL")
def tok_counts(spark, d):
    return terms.counts(articles(spark, d), tokens(), "source")


@query("tok_counts_by_year", f"WITH {A}, {CLEAN_T} SELECT lang, CAST(year(pub) AS INTEGER) AS year, term, count(*) AS n FROM t GROUP BY ALL")
def tok_counts_by_year(spark, d):
    return terms.counts(articles(spark, d).withColumn("year", F.year("pub")), tokens(), "lang", "year")


BIGRAMS = f"b AS (SELECT source, w[i] || ' ' || w[i + 1] AS term FROM (SELECT source, w, unnest(range(1, len(w))) AS i FROM (SELECT source, {TOKENS.replace('lower(text)', f'lower({STRIPPED})')} AS w FROM a)))"


@query("bigram_top20", f"""WITH {A}, {BIGRAMS}, c AS (SELECT source, term, count(*) AS n FROM b GROUP BY ALL)
SELECT source, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c WHERE n >= 2) WHERE rank <= 20""")
def bigram_top20(spark, d):
    counted = terms.pair_counts(articles(spark, d), tokens(), "source").filter("n >= 2")
    return terms.top(counted, ["source"], [F.desc("n"), F.asc("term")], 20)


@query("distinctive_bigrams", f"WITH {A}, {BIGRAMS}, c AS (SELECT source, term, count(*) AS n FROM b GROUP BY ALL), {SCORED.format(least=5)}")
def distinctive_bigrams(spark, d):
    out = terms.distinctive(terms.pair_counts(articles(spark, d), tokens(), "source"), "source", 5, 20)
    return out.withColumn("score", r6(F.col("score")))


@query("logodds_vocab", f"""WITH {A}, {CLEAN_T}, c AS (SELECT term, sum(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS fg, sum(CASE WHEN lang = 'fr' THEN 0 ELSE 1 END) AS bg FROM t GROUP BY term),
z AS (SELECT sum(fg) AS fgt, sum(CASE WHEN fg > 0 THEN 1 ELSE 0 END) AS fgv, sum(bg) AS bgt, sum(CASE WHEN bg > 0 THEN 1 ELSE 0 END) AS bgv FROM c),
s AS (SELECT term, fg, bg, ln(((fg + 0.5) / (fgt + 0.5 * fgv)) / ((bg + 0.5) / (bgt + 0.5 * bgv))) AS score FROM c, z WHERE fg >= 3)
SELECT term, CAST(fg AS BIGINT) AS fg, CAST(bg AS BIGINT) AS bg, round(score, 6) + 0.0 AS score FROM s ORDER BY round(score, 9) DESC, term LIMIT 10""")
def logodds_vocab(spark, d):
    counted = terms.counts(articles(spark, d).withColumn("own", F.col("lang") == "fr"), tokens(), "own")
    return terms.foreground_words(counted, "own", 3, 10).withColumn("score", r6(F.col("score")))


@query("logodds_fixedvocab", f"""WITH {A}, {CLEAN_T}, c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL),
v AS (SELECT term FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 500), g AS (SELECT DISTINCT lang FROM c),
f AS (SELECT g.lang, v.term, coalesce(c.n, 0) + 0.5 AS a FROM v CROSS JOIN g LEFT JOIN c ON c.lang = g.lang AND c.term = v.term),
o AS (SELECT *, sum(a) OVER (PARTITION BY term) - a AS o FROM f), s AS (SELECT *, ln(a / sum(a) OVER (PARTITION BY lang)) - ln(o / sum(o) OVER (PARTITION BY lang)) AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS rank FROM s)
SELECT lang, term, CAST(a - 0.5 AS BIGINT) AS n, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def logodds_fixedvocab(spark, d):
    out = terms.vocabulary_words(terms.counts(articles(spark, d), tokens(), "lang"), "lang", 2, 500, 20)
    return out.withColumn("score", r6(F.col("score")))


@query("cosine_before_after", f"""WITH {A}, {CLEAN_T}, c AS (SELECT CASE WHEN pub < DATE '2020-02-09' THEN 'before' ELSE 'after' END AS side, source, term, count(*) AS n FROM t GROUP BY ALL),
n AS (SELECT side, source, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL), p AS (SELECT side, term, n AS np FROM c WHERE source = 'src0'),
dot AS (SELECT c.side, c.source, sum(n * np) AS dot FROM c JOIN p ON p.side = c.side AND p.term = c.term GROUP BY ALL)
SELECT n.side, n.source, round(coalesce(dot, 0) / (n.norm * m.norm), 6) + 0.0 AS cosine FROM n JOIN n m ON m.side = n.side AND m.source = 'src0' LEFT JOIN dot ON dot.side = n.side AND dot.source = n.source WHERE n.source <> 'src0'""")
def cosine_before_after(spark, d):
    side = articles(spark, d).withColumn("side", F.when(F.col("pub") < F.lit("2020-02-09").cast("date"), "before").otherwise("after"))
    return terms.cosine(terms.counts(side, tokens(), "side", "source"), "source", "src0", "side").withColumn("cosine", r6(F.col("cosine")))


@query("rate_per_1000", f"WITH {A} SELECT CAST(year(pub) AS INTEGER) AS year, source, count(*) AS rows, round(1000.0 * avg(CASE WHEN contains(lower(text), 'ing') THEN 1 ELSE 0 END), 6) + 0.0 AS rate FROM a GROUP BY ALL")
def rate_per_1000(spark, d):
    return terms.rate(articles(spark, d).withColumn("year", F.year("pub")), X.hits(F.col("text"), ["ing"]), "year", "source").withColumn("rate", r6(F.col("rate")))


@query("rate_ratio", f"""WITH {A}, h AS (SELECT year(pub) AS year, source = 'src0' AS own, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END AS h FROM a)
SELECT CAST(year AS INTEGER) AS year, round(avg(CASE WHEN own THEN h END) / nullif(avg(CASE WHEN NOT own THEN h END), 0), 6) + 0.0 AS ratio FROM h GROUP BY year""")
def rate_ratio(spark, d):
    df = articles(spark, d).withColumn("year", F.year("pub"))
    return terms.rate_ratio(df, X.hits(F.col("text"), ["the"]), F.col("source") == "src0", "year").withColumn("ratio", r6(F.col("ratio")))


@query("heat_share", f"""WITH {A}, {CLEAN_T}, c AS (SELECT lang, CAST(year(pub) AS INTEGER) AS year, term, count(*) AS n FROM t GROUP BY ALL),
w AS (SELECT lang, term, sum(n) AS everywhere FROM c GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY everywhere DESC, term) AS k FROM w),
y AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY everywhere DESC, term) AS k FROM x WHERE k <= 60 AND length(term) >= 4),
tot AS (SELECT lang, year, sum(n) AS total FROM c GROUP BY ALL)
SELECT y.lang, tot.year, y.term, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / total, 3) AS share FROM y JOIN tot ON tot.lang = y.lang LEFT JOIN c ON c.lang = y.lang AND c.year = tot.year AND c.term = y.term WHERE k <= 20""")
def heat_share(spark, d):
    counted = terms.counts(articles(spark, d).withColumn("year", F.year("pub")), tokens(), "lang", "year")
    return terms.heat(counted, "lang", "year").withColumn("n", F.col("n").cast("long"))


JOINED = f"regexp_replace(regexp_replace(lower({STRIPPED}), 'of\\s+the', 'of_the', 'g'), 'de\\s+la', 'de_la', 'g')"


@query("collocation_tokens", f"WITH t AS (SELECT lang, unnest(regexp_extract_all({JOINED}, '[a-zà-ÿ][a-zà-ÿ]*(?:_[a-zà-ÿ][a-zà-ÿ]*)+|[a-zà-ÿ]{{3,}}')) AS term FROM documents) SELECT lang, term, count(*) AS n FROM t GROUP BY ALL")
def collocation_tokens(spark, d):
    return terms.counts(table(spark, d, "documents"), X.tokens(F.col("text"), [], [], PAIRS), "lang")


@query("language_gate", f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM documents)
SELECT doc_id, len(w) >= 15 AND coalesce(len(list_filter(w, lambda x: list_contains({listed(FOREIGN)}, x))) / nullif(len(w), 0) > 0.1, false) AS foreign_text FROM w""")
def language_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.mostly_foreign(F.col("text"), FOREIGN, 0.1).alias("foreign_text"))


@query("title_tokens", f"""WITH {A}, w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(title), '\\s+'), lambda x: trim(x, '.,;:!?"''()[]{{}}—–-')), lambda x: length(x) > 2 AND NOT list_contains({listed(['the', 'and', 'los', 'les'])}, x)) AS w FROM a)
SELECT doc_id, array_to_string(w, ' ') AS tokens FROM w""")
def title_tokens(spark, d):
    return articles(spark, d).select("doc_id", F.array_join(X.title_tokens(F.col("title"), ["the", "and", "los", "les"]), " ").alias("tokens"))


@query("analysis_clean", """WITH x AS (SELECT conv_id, turn, 'L uego ' || chr(160) || '<b class="x">' || text || '</b> alignleft wp-image-7' AS t FROM conversations)
SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(t, chr(160), ' '), chr(8203), ''), '<[^>]{0,300}>', ' ', 'g'),
  '(^|[^\\pL\\pN_\\pM])([A-ZÁÉÍÓÚÑÜ])\\s+([a-záéíóúñ]{2,})', '\\1\\2\\3', 'g'), '\\balign(?:center|left|right|none)?\\b', ' ', 'g'), '\\bwp-[a-z0-9_-]+', ' ', 'g')) AS cleaned FROM x""")
def analysis_clean(spark, d):
    wrapped = F.concat(F.lit("L uego  <b class=\"x\">"), F.col("text"), F.lit("</b> alignleft wp-image-7"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.clean_for_analysis(wrapped), 256).alias("cleaned"))


MEASURES = f"""p AS (SELECT conv_id, role, text, {WORDS} AS w FROM conversations),
m AS (SELECT role, CAST(conv_id % 12 AS BIGINT) AS ym, 100.0 * (length(text) - length(translate(text, '!?', ''))) / greatest(length(text), 1) AS exclaim,
  100.0 * len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) / greatest(len(w), 1) AS caps, CAST(len(w) AS DOUBLE) AS length,
  100.0 * CAST(contains(lower(text), 'the ') OR contains(lower(text), ' of ') AS INTEGER) AS en, 100.0 * CAST(contains(lower(text), 'que ') OR contains(lower(text), 'los ') AS INTEGER) AS es,
  100.0 * CAST(contains(lower(text), ' les ') OR contains(lower(text), 'eaux') AS INTEGER) AS fr FROM p)"""


FIRST = ["yo", "mi", "mis", "mio", "mia", "me", "conmigo"]
HOSTILE = ["enemigo", "traidor", "mentira", "corrupto", "corrupcion", "oligarca", "ataque", "atacan", "conspiracion", "manipulacion", "fake", "mentiroso", "hipocrita", "fracasado"]
SHARE = "100.0 * len(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_\\pM]+'), lambda x: list_contains({}, x))) / greatest(len(w), 1)"
SAID = "q AS (SELECT conv_id, role, text || CASE turn % 3 WHEN 0 THEN ' Yo digo: ¡MENTIRA! mi traidor' WHEN 1 THEN ' meme mio fakes Fake' ELSE '' END AS text FROM conversations)"
MEANS = ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in ("exclaim", "caps", "i_lang", "confront", "length", "en", "es", "fr"))


@query("monthly_metrics", f"""WITH {SAID}, {MEASURES.replace('FROM conversations', 'FROM q').replace('AS exclaim,', f'AS exclaim, {SHARE.format(listed(FIRST))} AS i_lang, {SHARE.format(listed(HOSTILE))} AS confront,')}
SELECT ym, role, {MEANS}, count(*) AS n_posts FROM m GROUP BY ALL""")
def monthly_metrics(spark, d):
    k = F.col("turn") % 3
    more = F.when(k == 0, " Yo digo: ¡MENTIRA! mi traidor").when(k == 1, " meme mio fakes Fake").otherwise("")
    said = table(spark, d, "conversations").withColumn("text", F.concat("text", more))
    out = posts.monthly(said, "text", F.col("conv_id") % 12, "role", THEMES)
    return out.select("ym", "role", *[r6(F.col(c)).alias(c) for c in ("exclaim", "caps", "i_lang", "confront", "length", *THEMES)], "n_posts")


@query("theme_means", f"""WITH {MEASURES}, o AS (SELECT ym, role, avg(en) AS en, avg(es) AS es FROM m GROUP BY ALL), q AS (SELECT ym, avg(en) AS en, avg(es) AS es FROM o GROUP BY ym)
SELECT ym, round(en, 6) + 0.0 AS en, round(es, 6) + 0.0 AS es, round(avg(en) OVER (ORDER BY ym ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS smooth FROM q""")
def theme_means(spark, d):
    p = table(spark, d, "conversations").select((F.col("conv_id") % 12).alias("ym"), "role", *[(100.0 * X.hits(F.col("text"), THEMES[k]).cast("int")).alias(k) for k in ("en", "es")])
    out = series.rolling(series.mean_of_means(p, "ym", "role", "en", "es"), "en", "ym", name="smooth")
    return out.select("ym", *[r6(F.col(c)).alias(c) for c in ("en", "es", "smooth")])


@query("pattern_rates", """WITH p AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, round(100.0 * len(regexp_extract_all(text, '[Tt]h[a-z]')) / greatest(n, 1), 6) + 0.0 AS rate FROM p""")
def pattern_rates(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(X.pattern_rate(F.col("text"), "[Tt]h[a-z]")).alias("rate"))


@query("lexicon_share", "SELECT source, round(100 * avg(CAST(contains(lower(text), 'the ') OR contains(lower(text), ' of ') AS INTEGER)), 6) + 0.0 AS pct FROM documents GROUP BY source")
def lexicon_share(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(r6(F.coalesce(100 * F.avg(X.hits(F.col("text"), THEMES["en"]).cast("int")), F.lit(0.0))).alias("pct"))


@query("stopword_drop", f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS kept, CAST(len(regexp_extract_all(lower(text), '[a-zà-ÿ]{{3,}}')) AS BIGINT) AS found FROM documents")
def stopword_drop(spark, d):
    found = F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.size(X.without(found, STOP)).cast("long").alias("kept"), F.size(found).cast("long").alias("found"))


@query("word_counts", f"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("words"))


CT = "t AS (SELECT e.label AS topic, regexp_extract_all(lower(d.text), '[a-zà-ÿ]{3,}') AS w FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"
TFIDF = f"""{CT}, u AS (SELECT topic, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
c AS (SELECT topic, term, count(*) AS n FROM u GROUP BY ALL), v AS (SELECT term, sum(n) AS everywhere, count(*) AS df FROM c GROUP BY term ORDER BY everywhere DESC, term LIMIT 5000),
z AS (SELECT count(DISTINCT topic) AS topics FROM t), x AS (SELECT topic, term, n, (1 + ln(n)) * (ln((1 + topics) / (1 + df)) + 1) AS raw FROM c JOIN v USING (term), z),
y AS (SELECT topic, term, n, raw / sqrt(sum(raw * raw) OVER (PARTITION BY topic)) AS weight FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM y WHERE NOT list_contains({listed(STOP)}, term))"""


def _topic_words(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = terms.parts(docs, "text")
    docs = docs.repartition(n, "doc_id").join(labels.repartition(n, "doc_id"), "doc_id")
    return topics.topic_words(topics.class_tfidf(docs, "topic", X.vectorizer_terms(F.col("text")), 5000, n), "topic", STOP)


@query("ctfidf", f"WITH {TFIDF} SELECT topic, term, n, round(weight, 6) + 0.0 AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def ctfidf(spark, d):
    return _topic_words(spark, d).withColumn("weight", r6(F.col("weight")))


@query("topic_labels", f"WITH {TFIDF} SELECT topic, string_agg(term, ' | ' ORDER BY rank) AS label FROM r WHERE rank <= 5 GROUP BY topic")
def topic_labels(spark, d):
    return topics.topic_labels(_topic_words(spark, d), "topic")


@query("vectorizer_vocab", f"WITH {A}, {CLEAN_T}, c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL) SELECT term FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 800")
def vectorizer_vocab(spark, d):
    return terms.fixed_vocabulary(terms.counts(articles(spark, d), tokens(), "lang"), "lang", 2, 800)


@query("topics_over_time", "WITH n AS (SELECT strftime(ts, '%Y-%m') AS period, event_type AS topic, count(*) AS n FROM events GROUP BY ALL) SELECT period, topic, n, round(100 * n / sum(n) OVER (PARTITION BY period), 6) + 0.0 AS pct FROM n")
def topics_over_time(spark, d):
    df = table(spark, d, "events").withColumnRenamed("event_type", "topic")
    return topics.over_time(df, "topic", F.date_format("ts", "yyyy-MM")).withColumn("pct", r6(F.col("pct")))


@query("topic_clusters")
def topic_clusters(spark, d):
    """doc, topic; clusters are not comparable between engines."""
    reduced = topics.reduced(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 16)
    return topics.clusters(reduced, k=8, seeds=2).select("vec_id", "topic")
