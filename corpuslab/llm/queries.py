"""The contract's queries ``opN_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, fingerprints, html_text, line_dedup, near_dup, quality_model, quality_rules, source_audit, spelling, toxicity, url_filter, warc
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS gram FROM b WHERE len(w) BETWEEN 1 AND 12
      UNION SELECT DISTINCT item_id, 13, array_to_string(list_slice(w, i, i + 12), ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
words AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_dedup.report(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_dropped", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, count(DISTINCT coalesce(text, '')) AS host_pages FROM d GROUP BY source),
l AS (SELECT source, text, trim(unnest(lines), ' ' || chr(9) || chr(13)) AS line FROM d),
c AS (SELECT source, line, count(DISTINCT text) AS pages FROM l WHERE line <> '' GROUP BY source, line),
bad AS (SELECT source, list(line) AS bad FROM c JOIN pages USING (source) WHERE pages >= 3 AND pages > 0.1 * host_pages GROUP BY source),
cut AS (SELECT doc_id, len(lines) AS n, list_filter(lines, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR NOT list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
        FROM d LEFT JOIN bad USING (source))
SELECT doc_id, CAST(coalesce(n - len(kept), 0) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS text_sha256, CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars FROM cut
"""


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
digits AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> s) & 31 AS BIGINT) + 1, 1), '' ORDER BY k, s DESC) AS payload_digest
  FROM (SELECT hex, k, CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT) AS n, unnest([15, 10, 5, 0]) AS s FROM (SELECT DISTINCT hex, unnest(range(8)) AS k FROM x)) GROUP BY hex),
u AS (SELECT page_id, string_split(lower(regexp_replace(url, '#.*', '')), '://')[2] AS rest FROM pages),
k AS (SELECT page_id, row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(regexp_extract(rest, '^[^/?]*'), '.')), ',') || ')' || regexp_extract(rest, '^[^/?]*(.*)$', 1), page_id) - 1 AS position FROM u)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, position
FROM x JOIN digits USING (hex) JOIN k USING (page_id)
"""


#: A fixed word limit is out of reach of texts without common words (their distance is about 0.32); a share of each language's own such distance is not.
OP8_RULES = quality_rules.Rules(max_bare_share=0.95)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), rules=OP8_RULES)


def _listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def op8_sql(rules: quality_rules.Rules = OP8_RULES) -> str:
    lists = " ".join(f"WHEN '={k}' THEN {_listed(v)}" for k, v in sorted(rules.common_words.items()))
    punctuation = quality_rules.CLASSES["punctuation"].replace("'", "''")
    js = """sqrt(greatest(0.0, 0.5 * list_sum(list_transform(range(1, len({p}) + 1), lambda i:
        CASE WHEN {p}[i] > 0 THEN {p}[i] / {sp} * log2(2 * ({p}[i] / {sp}) / ({p}[i] / {sp} + {q}[i] / {sq})) ELSE 0 END
        + CASE WHEN {q}[i] > 0 THEN {q}[i] / {sq} * log2(2 * ({q}[i] / {sq}) / ({p}[i] / {sp} + {q}[i] / {sq})) ELSE 0 END))))"""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
tri2 AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM tri),
rep AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS spot FROM (SELECT r, i FROM tri2 QUALIFY count(*) OVER (PARTITION BY r, g) > 1)) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.r, doc_id, lang, len(w) AS n_words, length(t) AS n_chars, length(array_to_string(w, '')) AS word_chars,
       length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
       length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit,
       length(t) - length(regexp_replace(t, '{punctuation}', '', 'g')) AS punct,
       CASE lang {lists} END AS common, list_filter(w, lambda x: list_contains(CASE lang {lists} END, x)) AS found
      FROM d LEFT JOIN rep ON rep.r = d.r JOIN l ON l.r = d.r),
h AS (SELECT *, CAST([upper, digit, punct, n_symbols, n_chars - word_chars, n_chars - upper - digit - punct - n_symbols - (n_chars - word_chars)] AS DOUBLE[]) AS c,
       CASE WHEN common IS NOT NULL THEN CAST(list_append(list_transform(common, lambda x: len(list_filter(found, lambda y: y = x))), n_words - len(found)) AS DOUBLE[]) END AS f,
       n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m),
rc AS (SELECT lang, list(s ORDER BY i) AS rc FROM (SELECT lang, i, sum(v) AS s FROM (SELECT lang, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS i FROM h WHERE NOT base_failed) GROUP BY lang, i) GROUP BY lang),
rf AS (SELECT lang, list(s ORDER BY i) AS rf FROM (SELECT lang, i, sum(v) AS s FROM (SELECT lang, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS i FROM h WHERE f IS NOT NULL AND NOT base_failed) GROUP BY lang, i) GROUP BY lang),
bare AS (SELECT lang, {js.format(p="b", q="rf", sp="1.0", sq="list_sum(rf)")} AS bare FROM (SELECT lang, rf, list_transform(range(1, len(rf) + 1), lambda i: CASE WHEN i = len(rf) THEN 1.0 ELSE 0.0 END) AS b FROM rf)),
j AS (SELECT h.*, CASE WHEN list_sum(c) > 0 AND list_sum(rc) > 0 THEN {js.format(p='c', q='rc', sp='list_sum(c)', sq='list_sum(rc)')} ELSE 0 END AS char_distance,
       CASE WHEN list_sum(f) > 0 AND list_sum(rf) > 0 THEN {js.format(p='f', q='rf', sp='list_sum(f)', sq='list_sum(rf)')} ELSE 0 END AS word_distance, bare FROM h LEFT JOIN rc USING (lang) LEFT JOIN rf USING (lang) LEFT JOIN bare USING (lang))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
       NOT base_failed AND NOT (n_chars >= {rules.min_hist_chars} AND char_distance > {rules.max_char_distance}) AND NOT (n_words >= {rules.min_hist_words} AND (word_distance > {rules.max_word_distance} OR coalesce(bare > 0 AND word_distance > {rules.max_bare_share} * bare, false))) AS kept
FROM j
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = url_filter.judge(table(spark, sf_dir, "pages"))
    return r.select("page_id", "host", "path", "rule", "verdict", F.array_join("strict", " ").alias("strict"), F.array_join("soft", " ").alias("soft"))


def op9_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    chosen = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    said = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in rules)
    found = lambda terms: ", ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END" for t in sorted(terms))
    return rf"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
       translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
h AS (SELECT *, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE WHEN host = '' THEN NULL {chosen} END AS rule,
       list_filter([{found(url_filter.STRICT)}], lambda x: x IS NOT NULL) AS strict, list_filter([{found(url_filter.SOFT)}], lambda x: x IS NOT NULL) AS soft FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {said} END WHEN len(strict) > 0 OR len(soft) >= {url_filter.Vocabulary().soft_limit} THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(array_to_string(strict, ' '), '') AS strict, coalesce(array_to_string(soft, ' '), '') AS soft
FROM f
"""


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.clusters(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, v FROM v) USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2) // CAST(n + 2 * v AS HUGEINT) AS BIGINT) AS p
      FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (total + 2) // CAST(n + 2 * v AS HUGEINT) AS BIGINT) AS q FROM kept JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: Near words are found by what is left without one letter; the checksum's table is made from its polynomial.
OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT range AS byte, range AS c, 0 AS k FROM range(256) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
e AS (SELECT doc_id, run, count(*) AS n, list_prepend(4294967295, list_transform(range(1, 2 * strlen(any_value(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), 2), lambda i: CAST('0x' || substr(hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run), i, 2) AS BIGINT))) AS b FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM e, crc),
s AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
         UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
o AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
f AS (SELECT o.word, n, n_near, form_n, (SELECT min(other) FROM near WHERE near.word = o.word AND near.m = o.form_n) AS form FROM o),
way AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON way.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fingerprints.edited(table(spark, sf_dir, "documents"))
    near = lambda c: fingerprints.likeness(F.col("fingerprint"), F.col(c))
    span = fingerprints.edited_span(F.col("fingerprint"), F.col("edited_fingerprint"))
    r = r.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"), span.alias("span"),
    )
    return r.select(*r.columns[:-1], F.col("span.first").alias("edited_from"), F.col("span.last").alias("edited_to"))


def queries() -> dict:
    own = (op1_decontamination, op2_toxicity, op3_quality_model, op4_bpe, op5_line_dedup, op6_html_text, op7_warc, op8_quality_rules, op9_url_filter, op10_near_dup, op11_source_audit, op12_spelling, op13_fingerprints)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op5_line_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op8_quality_rules": op8_sql(), "op9_url_filter": op9_sql(), "op11_source_audit": OP11_SQL, "op12_spelling": OP12_SQL}
