import re
"""Operators on small tables whose results are known, and properties that hold for all."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import classify, dedup, events, lookup, posts, series, terms, topics
from corpuslab.sources import tables
from corpuslab.streaming import incremental


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_dedup_url(spark):
    df = spark.createDataFrame([(1, 1, 0, "u1"), (2, 2, 0, "u1"), (3, 2, 1, ""), (4, 2, 2, None)], "id int, src_priority int, pos int, url string")
    assert ids(dedup.by_url(df)) == [1]


def test_pair_counts(spark):
    """Pairs of neighbours as ``bigrams`` makes them, also of groups without a name, of texts without a pair, and of a pair that a text has often."""
    from corpuslab.functions import text as X

    rows = [("s", "a b a b a"), ("s", "a b"), (None, "a b c"), (None, "b c"), ("", "a b"), ("t", "a"), ("t", ""), ("t", None), ("u", "x y " * 3000)]
    df = spark.createDataFrame(rows, "g string, x string").repartition(3)
    found = F.filter(F.split("x", " "), lambda w: w != "")
    got = terms.pair_counts(df, found, "g")
    assert got.columns == ["g", "term", "n"]
    want = {("s", "a b"): 3, ("s", "b a"): 2, (None, "a b"): 1, (None, "b c"): 2, ("", "a b"): 1, ("u", "x y"): 3000, ("u", "y x"): 2999}
    assert {(r.g, r.term): r.n for r in got.collect()} == want == {(r.g, r.term): r.n for r in terms.counts(df, X.bigrams(found), "g").collect()}
    assert {(r.term, r.n) for r in terms.pair_counts(df.filter("g = ''"), found).collect()} == {("a b", 1)}


def sequential_greedy(rows) -> list:
    """What ``greedy`` computes, over (order, keys) in order."""
    seen: set[str] = set()
    out = []
    for o, keys in rows:
        if not seen & {*keys}:
            seen |= {*keys}
            out.append(o)
    return out


def test_curate_shadowing(spark):
    long, short = "palabra " * 60, "palabra " * 45 + "\ncookies " + "x " * 10
    rows = [(1, 0, "u1", "d", "Un título bastante largo", short), (2, 1, "u2", "d", "Un título bastante LARGO", long), (3, 2, "u3", "bad", "otro título bastante largo", long), (4, 3, "u4", "d", "otro título bastante largo", long), (5, 4, "u5", "d", "x", "404"), (6, 5, "", "d", "y", long), (7, 6, "u7", "d", "z", "pocas palabras")]
    df = spark.createDataFrame([(*r[:2], 0, *r[2:]) for r in rows], "id int, pos int, src_priority int, url string, domain string, title string, text string")
    got = {r.id: r.reject_reason for r in dedup.curate(df, ["bad"]).collect()}
    assert got == {1: "short_clean", 2: "title", 3: "domain", 4: "kept", 5: "error", 6: "no_url", 7: "short"}
    assert sum(r.rows for r in dedup.audit(dedup.curate(df, ["bad"])).collect()) == len(rows)


CASCADE = [(1, 0, "u1", "T1", "a"), (2, 1, "u2", "T1", "b"), (3, 2, "u2", "T2", "c")]


def test_cascade_and_greedy_differ(spark):
    df = spark.createDataFrame([(*r, "s", "d") for r in CASCADE], "id int, pos int, url string, title string, text string, source string, date string")
    assert ids(dedup.cascade(df, F.col("url"), F.col("title"), [F.col("pos")])) == [1]
    assert ids(dedup.greedy(df, "url", "text", "source", "title", "date")) == [1, 3]


def test_domain_title(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, ""), (4, "")], "id int, title string").withColumn("d", F.lit("d"))
    assert ids(dedup.by_domain_title(df, "d", "title", [F.col("id")])) == [1, 3, 4]


@pytest.mark.parametrize("rounds", [60, 1])
def test_greedy_equals_sequential(spark, rounds):
    r = random.Random(rounds)
    rows = [(i, r.choice(["", *"abcdefgh"]), r.choice("qwertyuiop") * r.randint(1, 3), r.choice(["", *"klmnopqrs"])) for i in range(120)]
    df = spark.createDataFrame([(*x, "s", "d") for x in rows], "pos int, url string, text string, title string, source string, date string")
    keys = [(i, [k for k in ("u" + u if u else "", "f" + t, "k" + h if h else "") if k]) for i, u, t, h in rows]
    assert ids(dedup.greedy(df, "url", "text", "source", "title", "date", rounds=rounds), "pos") == sequential_greedy(iter(keys))


def test_first_is_idempotent(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(50)], "id int, k int")
    once = dedup.first(df, [F.col("k")], [F.col("id")])
    assert ids(once) == [*range(7)] == ids(dedup.first(once.repartition(3), [F.col("k")], [F.col("id")]))


def calendar(spark, rows):
    return spark.createDataFrame([(i, d, x) for i, (d, x) in enumerate(rows)], "idx int, d string, label string").select("idx", F.to_date("d").alias("event_date"), "label")


def test_windows(spark):
    cal = calendar(spark, [("2021-06-09", "e")])
    days = spark.createDataFrame([(k,) for k in (-61, -60, -30, -1, 0, 1, 30, 59, 60)], "k int").select(F.date_add(F.lit("2021-06-09").cast("date"), F.col("k")).alias("day"))
    n = lambda c: {r.side: r.n for r in events.in_windows(days, "day", cal, c).groupBy("side").agg(F.count("*").alias("n")).collect()}
    assert n("open30") == {"before": 2, "after": 2} and n("around30") == {"around": 5} and n("half60") == {"before": 3, "after": 4}
    one = events.before_after(days.filter("day > '2021-06-09'"), "day", cal).first()
    assert one.n_before == 0 and math.isinf(one.ratio)


def test_nearest(spark):
    cal = calendar(spark, [("2021-06-09", "a"), ("2021-09-07", "b"), ("2021-09-03", "c"), ("2022-03-27", "d"), ("2022-03-27", "e")])
    df = spark.createDataFrame([("2021-09-05",), ("2022-03-28",), ("2021-07-24",), (None,)], "s string").withColumn("day", F.to_date("s"))
    got = {r.s: (r.nearest_event, r.days_from_event) for r in events.nearest(df, "day", cal).collect()}
    assert got == {"2021-09-05": ("b", -2), "2022-03-28": ("d", 1), "2021-07-24": ("c", -41), None: (None, None)}


def test_months(spark):
    cal = calendar(spark, [("2020-02-09", "e")])
    df = spark.createDataFrame([(f"2020-{m:02d}-01",) for m in range(1, 6)], "s string")
    assert sorted(r.s for r in events.by_month(df, F.to_date("s"), cal).collect()) == ["2020-01-01", "2020-02-01", "2020-03-01"]


def test_a_calendar_is_small(spark):
    with pytest.raises(ValueError):
        events.small(spark.range(5), 4)


def test_rolling(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate((1, 4, 10, 1))], "m int, v double")
    assert [r.rolling for r in series.rolling(df, "v", "m").orderBy("m").collect()] == [2.5, 5, 5, 5.5]
    days = spark.range(60).select(F.expr("date_add(DATE'2020-01-01', CAST(id AS INT))").alias("day"), F.col("id").cast("double").alias("v"))
    assert series.daily(days, "day", F.col("v")).orderBy("day").collect()[30].rolling == 29.5


def test_series(spark):
    df = spark.createDataFrame([("2020-01-01", v, k) for v, k in ((1.0, "a"), (2.0, "a"), (4.0, "b"), (9.0, "b"), (None, "b"))], "s string, v double, k string").withColumn("day", F.to_date("s"))
    assert series.medians(df, "day", "v").first().v == 3.0
    assert sum(r.pct for r in series.shares_of(df, "s", "k").collect()) == 100
    assert series.mean_of_means(df, "s", "k", "v").first().v == 4.0
    assert series.crosstab(df, "s", "k", ["a", "b", "c"]).first().asDict() == {"s": "2020-01-01", "a": 2, "b": 3, "c": 0}


def test_fixed_vocabulary_scores(spark):
    counted = spark.createDataFrame([("g", "a", 4), ("g", "b", 1), ("h", "a", 1), ("h", "b", 3), ("h", "c", 2), ("g", "c", 0)], "g string, term string, n long")
    got = {r.term: r.score for r in terms.vocabulary_words(counted, "g").filter("g = 'g'").collect()}
    assert all(math.isclose(got[k], v, abs_tol=1e-5) for k, v in {"a": 1.241713, "b": -0.704197, "c": -1.466337}.items())


def test_log_odds_are_antisymmetric(spark):
    counted = spark.createDataFrame([("g", "a", 4), ("g", "b", 9), ("h", "a", 7), ("h", "b", 3)], "g string, term string, n long")
    s = {(r.g, r.term): r.score for r in terms.distinctive(counted, "g", 0).collect()}
    assert all(math.isclose(s["g", t], -s["h", t], abs_tol=1e-9) for t in "ab")


def test_cosine(spark):
    counted = spark.createDataFrame([("x", "p", "a", 2), ("x", "p", "b", 1), ("x", "q", "a", 1), ("x", "q", "c", 3)], "w string, g string, term string, n long")
    assert math.isclose(terms.cosine(counted, "g", "p", "w").first().cosine, 0.282843, abs_tol=1e-6)


def test_tfidf(spark):
    from corpuslab.functions import text as X

    df = spark.createDataFrame([(0, "gato gato perro"), (1, "perro pez")], "topic int, text string")
    got = {r.term: r.weight for r in topics.class_tfidf(df, "topic", X.vectorizer_terms(F.col("text"))).filter("topic = 0").collect()}
    assert all(math.isclose(got[k], v, abs_tol=1e-6) for k, v in {"gato": 0.730444, "gato gato": 0.431412, "gato perro": 0.431412, "perro": 0.306953}.items())


def test_clusters(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = topics.clusters(topics.reduced(df, "embedding", 8), k=5, seeds=2)
    assert out.count() == df.count() and out.filter("topic is null or topic not between 0 and 4").count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(1, "Uno DOS"), (2, "dos"), (3, None)], "id int, text string").withColumn("l", classify.labels(F.col("text"), {"one": [r"\buno\b"], "two": ["dos"]}))
    assert [r.l for r in df.orderBy("id").collect()] == [["one", "two"], ["two"], []]
    assert {(r.id, r.label_a) for r in classify.cross(df.withColumn("m", F.array().cast("array<string>")), "l", "m", "(none)", "-").collect()} == {(1, "one"), (1, "two"), (2, "two"), (3, "(none)")}
    placed = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "g string, i int")
    assert {(r.g, r.i, r.which) for r in classify.examples(placed, "g", ["i"]).collect()} == {("a", 0, "first"), ("a", 2, "middle"), ("a", 4, "last"), ("b", 9, "first")}
    rows = spark.createDataFrame([("a", "x", 1, "p"), ("a", "x", 5, "q"), ("a", "y", 2, "r")], "a string, b string, likes int, t string")
    assert classify.nested(rows, "a", "b", "likes", "t").first().lookup == '{"x":["q","p"],"y":["r"]}'


def test_fan_out_and_resume(spark):
    p = lookup.literal(spark, [(2022, 9)], "year int, month int")
    c = lookup.literal(spark, [(2022, 9, "a"), (2022, 9, "b")], "year int, month int, x string")
    assert lookup.enrich(p, c, "year", "month").count() == 2 and lookup.enrich(p, None, "year").count() == 1
    assert lookup.unseen(c, p, "year", "month").count() == 0 and lookup.unseen(c, None, "year").count() == 2


def test_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('﻿url,text\nu1,"two\nlines ""quoted"""\n', encoding="utf-8")
    rows = tables.csv_rows(spark, f"{tmp_path}/in", ["url", "text"]).collect()
    assert [tuple(r) for r in rows] == [("u1", 'two\nlines "quoted"')]
    df = spark.createDataFrame([("u", "a\nb", 1)], "url string, text string, extra int")
    tables.write_csv(df, f"{tmp_path}/out", ["url", "text"])
    assert [tuple(r) for r in tables.csv_rows(spark, f"{tmp_path}/out", ["url", "text"]).collect()] == [("u", "a\nb")]
    typed = tables.typed(spark.createDataFrame([("2020-01-02", "1,5", "False", None)], "d string, n string, f string, t string"), {"d": "yyyy-MM-dd"}, ("n",), ("f",)).first()
    assert typed.d.year == 2020 and typed.n == 15 and typed.f is False and typed.t == ""


def test_landed_sources(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://a/1</loc><lastmod>2020-01-01</lastmod></url><url><loc>http://a/2</loc></url></urlset>")
    assert [tuple(r) for r in tables.sitemap(spark, f"{tmp_path}/s.xml").orderBy("loc").collect()] == [("http://a/1", "2020-01-01"), ("http://a/2", None)]
    j = spark.createDataFrame([('[{"id_institucion":1,"nombre_institucion":"x","acronym":"X","id_tipo":2},{"id_institucion":1,"nombre_institucion":"x"}]',)], "p string")
    assert tables.institutions(j, "p").count() == 1
    raw = spark.createDataFrame([("1", "2020", "", "n", "1,000", "a"), ("0", "2020", "u", "n", "1", None), ("2", "2010", "u", "n", "1", None), ("3", "x", "http://a/b.pdf", None, "", None)], "id_documents string, year string, file_url string, name string, downloads string, document_file_name_anexo string")
    got = {r.id_documents: r for r in tables.documents_of(raw, "b").collect()}
    assert set(got) == {1, 3} and got[1].downloads == 1000 and got[1].has_annex and got[3].file_extension == "pdf" and got[3].year is None
    assert tables.url_column(["a", "my_url"]) == "my_url"
    live, arch = (spark.createDataFrame(r, "url string, text string") for r in ([("u1", "L")], [("u1", "A"), ("u2", "B")]))
    broken = spark.createDataFrame([("u1", ""), ("u2", ""), ("u3", "")], "url string, text string")
    assert {(r.url, r.text, r.repaired_from) for r in tables.repaired(broken, live, arch).collect()} == {("u1", "L", "live"), ("u2", "B", "archive")}
    std = tables.labelled(spark.createDataFrame([(" u ", "2020", "1", "t", "www.A.org", "x", "5", 1)], "url string, year string, month string, title string, domain string, text string, word_count string, pos long"), "s", 2).first()
    assert (std.url, std.domain, std.word_count, std.src_priority) == ("u", "a.org", 5, 2)


def test_cached_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string")
    made = []

    def make(rows):
        made.append(rows.count())
        return rows.withColumn("embedding", F.array(F.length("text").cast("float")))

    for more in (df, df.union(spark.createDataFrame([(4, "c")], "id int, text string"))):
        assert tables.cached_vectors(spark, more, "text", f"{tmp_path}/v", make).filter("embedding is null").count() == 0
    assert made == [2, 1]


def test_parsed_posts(spark):
    raw = spark.createDataFrame([("1", "a\r\nb", "Mon Jan 01 00:00:00 +0000 2024", 3), ("1", "a\r\nb", "Mon Jan 01 00:00:00 +0000 2024", 3), ("2", "RT @x y", "", 1), ("3", "c", "bad", None)], "id string, text string, createdAt string, likeCount long").selectExpr("*", "0L AS retweetCount", "0L AS replyCount", "0L AS quoteCount", "0L AS viewCount", "'es' AS lang")
    got = {r.tweet_id: (r.text, r.year, r.likes) for r in posts.parsed(raw, "h", "a").collect()}
    assert got == {"1": ("a b", 2024, 3), "3": ("c", None, 0)}


def test_stream_equals_batch(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.union(df.limit(50)).repartition(3).write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        incremental.append_unseen(incremental.stream(spark, src, df.schema, 1), out, f"{tmp_path}/c", "event_id").awaitTermination()
    got = incremental.loaded(spark, out)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    q = incremental.daily_counts(incremental.stream(spark, src, df.schema), "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(src).groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.d, r.event_type, r.n) for r in batch.collect()} == {(r.day.start.date(), r.event_type, r.n) for r in spark.table("daily").collect()}


def test_failed_batch_is_written_once(spark, tmp_path):
    """A batch that fails after it was written is run again, writes the same folder, and its keys are still new to it; later files bring no seen key."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema, tries = "k long, v string", []

    def put(batch, path):
        batch.write.mode("overwrite").parquet(path)
        tries.append(path)
        if len(tries) == 2:
            raise RuntimeError("lost")

    for n in range(3):
        spark.range(n * 40, n * 40 + 60).selectExpr("id AS k", f"'{n}' AS v").coalesce(1).write.mode("append").parquet(src)
    start = lambda: incremental.append_unseen(incremental.stream(spark, src, schema, 1), out, f"{tmp_path}/c", "k", write=put)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    assert len(tries) == 4 and tries[1] == tries[2]
    assert sorted(r.k for r in incremental.loaded(spark, out).collect()) == list(range(140))
    spark.range(130, 150).selectExpr("id AS k", "'late' AS v").coalesce(1).write.mode("append").parquet(src)
    start().awaitTermination()
    assert sorted(r.k for r in incremental.loaded(spark, out).collect()) == list(range(150))


def test_partitions_do_not_matter(spark):
    from corpuslab.plans.base import articles

    df = articles(spark, "/root/testdata/sf0.001")
    a, b = (sorted(map(tuple, dedup.curate(d.withColumn("domain", F.col("source")), []).select("doc_id", "reject_reason").collect())) for d in (df, df.repartition(7)))
    assert a == b


def test_ids_and_places_need_no_window_over_a_key(spark):
    from corpuslab.operators import classify, lookup, ranges

    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "n int, key string").repartition(7)
    want, seen = {}, {}
    for n, key in rows:
        seen[key] = seen.get(key, 0) + 1
        want[n] = None if key is None else f"{key}_{seen[key]:06d}"
    out = lookup.ids(df, "key", ["n"])
    got = {r.n: r.id for r in out.collect()}
    assert {n: v for n, v in got.items() if want[n]} == {n: v for n, v in want.items() if v} and len(got) == 3000
    shown = classify.examples(df.filter("key = 'hot'"), "key", ["n"])
    hot = [n for n, key in rows if key == "hot"]
    assert sorted((r.n, r.which) for r in shown.collect()) == sorted([(hot[0], "first"), (hot[len(hot) // 2], "middle"), (hot[-1], "last")])
    for df_ in (out, shown):
        assert "Window" not in df_._jdf.queryExecution().executedPlan().toString()
    p = ranges.placed(df, [F.col("n")], ranges=5)
    assert p.total == 3000 and [r.n for r in p.rows.orderBy("_place").collect()] == list(range(3000))
    sparse = p.rows.withColumn("v", F.when(F.col("n") % 997 == 3, F.col("n")))
    c = {r.n: (r._last, r._next) for r in ranges.carried(ranges.Placed(sparse, p.sizes), "v").collect()}
    at = [n for n in range(3000) if n % 997 == 3]
    assert all(c[n] == (max((x for x in at if x <= n), default=None), min((x for x in at if x >= n), default=None)) for n in range(3000))
    empty = ranges.placed(df.filter("n < 0"), [F.col("n")])
    assert empty.total == 0 and ranges.carried(empty, "n").count() == 0 and lookup.ids(df.filter("n < 0"), "key", ["n"]).count() == 0


def test_chain_of_greedy_rows(spark):
    """Row i shares its URL or its title with the next one: every second row stays. Longer than the rounds are many."""
    n = 100_000
    i = F.col("id")
    df = spark.range(n).select(
        i.alias("pos"), F.concat(F.lit("http://x.org/"), F.expr("string((id + 1) div 2)")).alias("url"), F.concat(F.lit("text "), i.cast("string")).alias("text"), F.lit("s").alias("source"),
        F.concat(F.lit("title "), F.expr("string(id div 2)")).alias("title"), F.lit("2020").alias("date"),
    )
    out = dedup.greedy(df, "url", "text", "source", "title", "date")
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(r.pos for r in out.select("pos").collect())
    assert got == list(range(0, n, 2))


def test_greedy_equals_sequential_pass(spark):
    import random

    r = random.Random(5)
    rows = [(k, f"http://x.org/{r.randint(0, 90)}", f"t{r.randint(0, 150)}", "s", f"title {r.randint(0, 120)}", "2020") for k in range(260)]
    # ladders, in which a row waits for two others
    rows += [(300 + k, f"http://y.org/{k // 2}", f"u{(k + 1) // 3}", "s", f"other {(k + 1) // 2}", "2020") for k in range(60)]
    df = spark.createDataFrame(rows, "pos long, url string, text string, source string, title string, date string")
    seen, want = set(), []
    for pos, url, text, source, title, date in rows:
        keys = {("u", url), ("f", text), ("k", source, title, date)}
        if not seen & keys:
            seen |= keys
            want.append(pos)
    for rounds in (2, 8, 60):
        assert sorted(x.pos for x in dedup.greedy(df, "url", "text", "source", "title", "date", rounds=rounds).select("pos").collect()) == want


def test_csv_of_one_large_file_is_read_by_ranges(spark, tmp_path):
    from corpuslab.sources import tables as S

    note = F.when(F.col("id") % 3 == 0, F.lit('a "quoted", \n\n field')).when(F.col("id") % 7 == 0, F.repeat(F.lit('line "of", a long\nfield\n'), 200)).when(F.col("id") % 5 == 0, F.lit('"')).otherwise(F.lit("plain"))
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), note.alias("note"), F.when(F.col("id") % 2 == 0, F.lit("")).alias("end"))
    path = f"{tmp_path}/one"
    S.write_csv(df.coalesce(1), path, ["id", "note", "end"])
    want = spark.read.schema("id string, note string, end string").options(header=True, multiLine=True, escape='"').csv(path).collect()  # in one task
    assert sorted((r.id, r.note) for r in want) == sorted((r.id, r.note) for r in df.collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "16k", "64k"):  # records of 5 kB cover whole ranges of the first
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = S.csv_rows(spark, path, ["id", "note", "end"])
            assert spark.read.text(path).rdd.getNumPartitions() > 8
            assert sorted(map(str, got.collect())) == sorted(map(str, want)), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match="not the header"):
        S.csv_rows(spark, path, ["id", "other", "end"]).collect()
    S.write_csv(df.limit(0), f"{tmp_path}/none", ["id", "note", "end"])
    assert S.csv_rows(spark, f"{tmp_path}/none", ["id", "note", "end"]).count() == 0


def test_as_of_merge(spark):
    from corpuslab.operators import events

    days = spark.range(0, 4000, 7).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    cal = spark.range(0, 400).select(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") * 37 % 2500).cast("int")).alias("event_date"), F.col("id").cast("int").alias("idx"), F.col("id").cast("string").alias("label"))
    a, b = (sorted(map(tuple, events.nearest(days, "day", cal, most=m).collect())) for m in (0, 10_000))
    assert a == b and len(a) == days.count()
    many = spark.range(1_000_000).select(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") * 7919 % 30_000).cast("int")).alias("event_date"), F.col("id").cast("int").alias("idx"), F.lit("e").alias("label"))
    out = events.nearest(days, "day", many)
    assert not re.search("CartesianProduct|NestedLoop", out._jdf.queryExecution().executedPlan().toString()) and out.filter("days_from_event is null").count() == 0
    none = events.nearest(days.union(spark.sql("SELECT CAST(NULL AS DATE)")), "day", cal.limit(0), most=0)
    assert none.count() == days.count() + 1 and none.filter("nearest_event is not null").count() == 0


def test_interval_join(spark):
    import random

    from corpuslab.operators import events

    r = random.Random(1)
    at = [(k, r.randint(0, 10**6)) for k in range(300)] + [(999, None)]
    spans = [(k, a, a + r.choice([0, 1, 10, 1000, 65_536, 10**6])) for k, a in ((k, r.randint(-1000, 10**6)) for k in range(120))] + [(500, 9, 3), (501, None, 4)]
    df = spark.createDataFrame(at, "k long, t long").select("k", F.timestamp_micros("t").alias("t"))
    iv = spark.createDataFrame(spans, "j long, a long, z long").select("j", F.timestamp_micros("a").alias("first"), F.timestamp_micros("z").alias("last"))
    for low, high in ((True, True), (False, True), (True, False), (False, False)):
        want = sorted((k, j) for k, t in at for j, a, z in spans if None not in (t, a) and a <= z and (a < t or low and a == t) and (t < z or high and t == z))
        out = events.in_intervals(df, "t", iv, with_first=low, with_last=high)
        assert sorted((x.k, x.j) for x in out.collect()) == want and not re.search("CartesianProduct|NestedLoop", out._jdf.queryExecution().executedPlan().toString())
    assert events.in_intervals(df, "t", iv.limit(0)).count() == 0


def test_totals_in_intervals(spark):
    """As pairs that are added up, but without a join of rows with intervals: all rows lie in all intervals of the last part, and no pair of them is made."""
    import random

    from corpuslab.operators import events

    r = random.Random(2)
    at = [(k, r.randint(0, 3000)) for k in range(400)] + [(999, None), (None, 5)]
    spans = [(k % 40, a, a + r.choice([0, 1, 10, 1000])) for k, a in ((k, r.randint(-100, 3000)) for k in range(120))] + [(500, 9, 3), (501, None, 4), (None, 0, 100), (None, 50, 70)]
    df = spark.createDataFrame(at, "k long, t long").select("k", F.timestamp_micros("t").alias("t"))
    iv = spark.createDataFrame(spans, "j long, a long, z long").select("j", F.timestamp_micros("a").alias("first"), F.timestamp_micros("z").alias("last"))
    for low, high in ((True, True), (False, True), (True, False), (False, False)):
        want = {j: (0, 0) for j, _, _ in spans}
        for k, t in at:
            for j, a, z in spans:
                if None not in (t, a) and a <= z and (a < t or low and a == t) and (t < z or high and t == z):
                    want[j] = want[j][0] + 1, want[j][1] + (k or 0)
        out = events.totals_in_intervals(df, "t", iv, "j", value="k", with_first=low, with_last=high)
        assert {x.j: (x.n, x.total) for x in out.collect()} == want and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert events.totals_in_intervals(df, "t", iv.limit(0), "j").count() == 0
    assert {x.n for x in events.totals_in_intervals(df.limit(0), "t", iv, "j").collect()} == {0}
    hot = spark.range(60_000).select("id", F.timestamp_micros(F.col("id") % 50).alias("t"))
    n = events.before_after_hours(hot, "t", hot, "id", "t").groupBy("n_before", "n_after").count().collect()
    assert {tuple(x) for x in n} == {(1200 * k, 1200 * (49 - k), 1200) for k in range(50)}


def test_selected_medians(spark):
    import random
    import statistics

    from corpuslab.operators import series

    r = random.Random(3)
    groups = {"hot": [r.random() for _ in range(7001)], "even": [r.gauss(0, 1e6) for _ in range(2000)], "same": [5.0] * 900, "two": [1.0] * 500 + [2.0] * 500, "wide": [10.0 ** r.randint(-300, 300) for _ in range(999)], "one": [3.0], "steps": [float(k // 400) for k in range(2001)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), (None, 1.5), (None, 2.5), ("nulls", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    want = {k: statistics.median(v) for k, v in groups.items()} | {None: 2.0}
    for most in (1, 50, 10_000):
        got = {x.g: x.v for x in series.selected_medians(df, "g", "v", most=most, accuracy=100).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-12 * abs(want[k]) for k in want), most
    months = df.select(F.lit("2020-01-05").cast("date").alias("day"), "v").filter("not isnan(v) or v is null")
    assert series.medians(months, "day", "v", most=100).first().v == series.medians(months, "day", "v").first().v


def test_medians_do_not_gather_groups(spark, monkeypatch):
    """Rows meet the bounds of their group where they are; of many groups only small ones' rows are shuffled."""
    from corpuslab.llm.common import settings
    from corpuslab.operators import series
    from corpuslab.operators.scratch import saved

    df = spark.range(6000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 6007).cast("double").alias("v"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        state = saved(df.groupBy(F.col("g").alias("_k")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("between")))
        plan = series._between(df.toDF("_k", "_v"), state)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    want = {r.g: r.v for r in df.groupBy("g").agg(F.median("v").alias("v")).collect()}
    monkeypatch.setattr(series, "MOST_SENT", 0)
    for large in (10, 1_000_000):
        monkeypatch.setattr(series, "MOST_AT_ONCE", large)
        assert {r.g: r.v for r in series.selected_medians(df, "g", "v", most=50, accuracy=100).collect()} == want


def test_phrases_are_those_of_the_patterns(spark):
    from corpuslab import lexicons as L
    from corpuslab.functions import text as X

    texts = ["nuevas ideas", "nuevas  ideas", "nuevas\nideas", "xnuevas ideas", "nuevas ideas, fmln.", "barrio 18 y barrio 180", "sala de lo constitucional de la sala", "gana-pcn", "gana_pcn", "año política É", "ONG ong Ong", "", None, "la corte de cuentas la corte suprema"]
    lists = sorted({k.lower() for k in L.STRONG_KEYWORDS + L.NORMAL_KEYWORDS})
    low = F.lower(X.filled(F.col("t")))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.found_phrases(low, lists).alias("found"), *[low.rlike(X.whole(k)).alias(f"k{i}") for i, k in enumerate(lists)]).collect():
        assert sorted(r.found) == [k for i, k in enumerate(lists) if r[f"k{i}"]], r.t
    plan = df.select(X.relevance(F.col("t"), F.lit(""))).selectExpr("*")._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan
    with pytest.raises(ValueError):
        X.found_phrases(low, ["a-b"])
