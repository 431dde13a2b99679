"""Scalar functions on rows whose results are known."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import dates as D
from corpuslab.functions import html as H
from corpuslab.functions import text as X
from corpuslab.functions import urls as U


@pytest.fixture
def each(spark):
    def run(function, *values):
        rows = [(i, v) for i, v in enumerate(values)]
        out = spark.createDataFrame(rows, "i int, x string").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
        return [r.y for r in out]

    return run


def test_cleaning(each):
    assert each(X.clean_for_analysis, "L uego los M iembros", "a b​c<b>d</b>", "x aligncenter y wp-image-3 z", None) == ["Luego los Miembros", "a bc d ", "x   y   z", ""]
    assert each(X.repair_mojibake, "aÃ±o", "año", "日本", None) == ["año", "año", "日本", ""]
    assert each(X.clean_for_curation, "Nacional\n\nTexto\n\n\n\nfin\nir al inicio ahora", "x\npor\nAna\nhace 3 horas\n12\nCuerpo © 2020\nsuscríbete ya") == ["Texto\n\nfin", "Cuerpo  2020"]
    assert each(X.normalise_whitespace, " a\t\tb \n\n\n\n c d ") == ["a b\n\nc d"]
    assert each(lambda x: X.strip_boilerplate(x), "Publicidad hoy Tags: x") == [" hoy  x"]
    assert each(X.drop_controls, "a\x01b\nc\x7f") == ["ab\nc"]
    assert each(lambda x: H.nfc(x), "é") == ["é"]


def test_tokens(each):
    assert each(lambda x: X.tokens(x, ["del"]), "el estado de  excepción sigue vigente @uno #dos http://x.y/z del", "capilla paz") == [["estado_excepcion", "sigue", "vigente"], ["capilla_paz"]]
    assert each(lambda x: X.plain_tokens(x, ["que"]), "Año que viene: sí, mañana")[0] == ["año", "viene", "mañana"]
    assert each(lambda x: X.title_tokens(x), '"Última" hora: el presidente — ¡no!') == [["última", "hora", "¡no"]]
    assert each(lambda x: X.bigrams(F.split(x, " ")), "a b c", "a") == [["a b", "b c"], []]
    assert each(lambda x: X.bigrams(F.filter(F.split(x, " "), lambda w: w != "")), "") == [[]]
    assert each(X.words, " a  b\n", None) == [["a", "b"], []]
    assert each(lambda x: X.mostly_foreign(x, ["the", "and"]), "the and " * 8, "the and", "uno dos tres " * 9) == [True, False, False]


def test_tokens_without_phrases(each):
    """Texts with and without ``_`` give what one pattern for both gives."""
    values = ["Foo_bar a_b x_ abc_ _abc ab_1 un deux", "Foo bar, ab abc, École÷ñandú ÀÉÎ ß", "@a_b http://x_y/z #t_u abc", "ab", "", None, "abc" * 5000]
    lowered = [re.sub(r"https?://\S+|@\w+|#\w+", " ", v or "").lower() for v in values]
    want = [[w for w in re.findall("[a-zà-ÿ]+(?:_[a-zà-ÿ]+)+|[a-zà-ÿ]{3,}", t) if w != "bar"] for t in lowered]
    assert each(lambda x: X.tokens(x, ["bar"], [], []), *values) == want and want[0][:2] == ["foo_bar", "a_b"]
    assert X.LETTER == "[" + "".join(re.findall("[a-zà-ÿ]", "".join(map(chr, range(0x250))))) + "]"


def test_rates(each):
    t = "¡NO! Yo digo que MI país es LIBRE?"
    assert [round(v, 6) for v in (each(X.exclamation_rate, t)[0], each(X.capitals_rate, t)[0], each(lambda x: X.pattern_rate(x, r"(?iU)\b(yo|mi\b)\b"), t)[0])] == [5.882353, 37.5, 25.0]
    assert each(X.exclamation_rate, "", None) == [0.0, 0.0]
    assert each(lambda x: X.hits(x, ["inversion"]), "Inversion", "inversión") == [True, False]


def test_relevance(each):
    assert each(lambda x: X.relevance(x, x, ["bukele"], ["ley", "ONG"]), "Bukele: ley y ley, ong", "leyes") == [4, 0]
    assert each(lambda x: X.irrelevant_title(x), "Fútbol hoy", "Bukele y el fútbol", "nada") == [True, False, False]
    assert each(lambda x: X.about(x), "El Salvador El Salvador CECOT", "El Salvador, El Salvador", "El Salvador maras fmln arena", "Bukele bukele") == [True, False, True, True]
    assert each(lambda x: X.error_page(x, F.lit("")), "Page NOT found", "Página que no existe", "bien") == [True, True, False]


def test_numbers(each):
    assert each(X.parse_count, "1,234", "1.2K", "3.4M", "12 comentarios", "1.234 vistas", "n/a", None) == [1234, 1200, 3400000, 12, 1234, None, None]
    assert each(X.safe_int, "111,983", "x", "", None) == [111983, 0, 0, 0]
    assert each(X.safe_year, "2020", "1800", "x") == [2020, None, None]
    assert each(lambda x: X.document_url(x, "u"), "12") == ["u?id=MTI=&inst=12"]
    assert each(X.extension, "http://a/b.PDF?x=1.txt", "http://a/b") == ["pdf", ""]
    assert each(lambda x: X.title_key(x), "¡Última HORA: ley 21!") == ["últimahoraley21"]
    a, b = each(X.fingerprint, "  Uno\n\n dos ", "uno dos")
    assert a == b


def test_dates(each):
    d = dt.date
    assert each(D.flexible, "12 de mayo de 2021", "2021-05-06", "06/05/2021", "mayo 2021", "mayo de 2021", "nada", None, "31 de febrero de 2021") == [d(2021, 5, 12), d(2021, 5, 6), d(2021, 5, 6), d(2021, 5, 1), d(2021, 5, 1), None, None, d(2021, 2, 1)]
    assert each(D.of_url, "/2021/06/09/x", "/2021/06/x", "/slug/64046/2026/", "/2021/13/40/x", "/a-2020-02-03", "/20200203/", None) == [d(2021, 6, 9), d(2021, 6, 15), d(2026, 6, 15), None, d(2020, 2, 3), d(2020, 2, 3), None]
    assert [tuple(x) for x in each(D.year_month, "2021-05-06", "20210506", "2021/05", "2021", "")] == [("2021", "05")] * 3 + [("2021", ""), ("", "")]
    assert each(D.year_of_url, "/202203/x", "/1999/01/", "/x/2014/", "/2021/13/") == [2022, None, 2014, None]
    assert each(D.social, "Mon Jan 01 00:00:00 +0000 2024", "x") == [dt.datetime(2024, 1, 1), None]
    assert each(lambda x: D.in_range(F.to_date(x)), "2015-01-01", "2026-01-01", None) == [True, False, False]


def test_urls(each):
    assert each(U.normalise, "http://a/b/?utm_source=x#top") == ["http://a/b"]
    assert each(lambda x: U.domain(F.lit(None), x), "https://www.A.org/x", "nope") == ["a.org", ""]
    assert each(U.article, "http://a.org/nota-larga", "http://a.org/deportes/uno-dos", "short", None) == [True, False, False, False]
    assert each(lambda x: U.prefilter(x), "http://a/2012/01/x", "http://a/futbol", "http://a/futbol-bukele", "http://a/x") == [False, False, True, True]
    assert each(lambda x: U.relevance(x, ["sport"], ["news"]), "http://a/sport/news", "http://a/news-x", "http://a/x", None) == [False, True, None, None]
    assert each(lambda x: U.homepage_redirect(F.lit("http://www.a.org/x"), x), "http://a.org/x", "http://a.org/", "http://b.org/x") == [False, True, True]
    assert each(lambda x: U.geo_reason(x, F.lit("US"), ["a.sv"], ["b.org"]), "http://a.sv/x", "http://b.org/", "http://c.org/", "http://a.sv/mundo/x", "") == ["kept", "domain", "geo", "section", "no_url"]


PAGE = """<html><head><meta content="2021-01-02" property="article:published_time"><title>T</title><script type="application/ld+json">{"commentCount": "12", "interactionStatistic":
[{"interactionType": "LikeAction", "userInteractionCount": "1.5K"}]}</script></head><body><nav>menu</nav><h1>H <b>x</b></h1><article><div class="entry-content"><p>%s</p><div class="share-box">s</div></div></article>
<span class="view-count">3,200 visitas</span><a href="/a?x=1">1</a><a href="http://b.org/c#d">2</a><a href="e/f">3</a><a href="mailto:q">4</a></body></html>""" % ("Texto del artículo. " * 8)


def test_html(each):
    assert each(H.title, PAGE, "<h1></h1><title> t </title>", None) == ["H x", "t", None]
    assert each(H.date_text, PAGE, "<time datetime='2020-01-01'>", "<p>12 de mayo de 2021</p>", "<p>x</p>") == ["2021-01-02", "2020-01-01", "12 de mayo de 2021", None]
    assert each(lambda x: H.links(x, F.lit("http://a.org/x/y")), PAGE) == [["http://a.org/a", "http://b.org/c", "http://a.org/x/e/f"]]
    assert each(lambda x: H.content_of(x), PAGE, None) == [("Texto del artículo. " * 8).strip(), ""]
    assert "menu" not in each(lambda x: H.text_of(x), PAGE)[0]
    e = each(H.engagement, PAGE, None)
    assert tuple(e[0]) == (12, 1500, None, 3200) and tuple(e[1]) == (None,) * 4


def test_log_odds(spark):
    from corpuslab.operators import terms

    lits = lambda *v: [F.lit(float(x)) for x in v]
    m1 = [terms.log_odds(*lits(*v)) for v in ((10, 100, 5, 400), (8, 50, 0, 200), (5, 5, 0, 10))]
    m2 = [terms.vocabulary_log_odds(*lits(*v)) for v in ((10, 100, 40, 5, 400, 90), (3, 20, 10, 0, 100, 50))]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(m1 + m2)]).first()
    assert all(math.isclose(a, b, abs_tol=1e-4) for a, b in zip(got, (2.125703, 4.393861, 23.718998, 1.957210, 3.555348), strict=True))


def test_json_ld(each):
    ld = lambda *bodies: "".join(f'<script type="application/ld+json">{b}</script>' for b in bodies)
    value = lambda h: H.json_value(h, "datePublished", "dateCreated")
    pages = [
        ld('{"@graph": [{"@type": "WebPage"}, {"dateCreated": "2019-01-01", "datePublished": "2020-02-02"}]}'), ld('[{"x": 1}, {"datePublished": "a \\"quoted\\" \\u00e9"}]'),
        ld('{"datePublished": "broken', '{"dateCreated": "2018-01-01"}'), ld('[{"@graph": [{"datePublished": "in a list"}]}]'), ld('{"text": "\\"datePublished\\": \\"no\\""}'),
        '<script>{"datePublished": "other script"}</script>', ld('{"datePublished": ""}', '{"datePublished": 2020}'), None,
    ]
    assert each(value, *pages) == ["2020-02-02", 'a "quoted" é', "2018-01-01", "in a list", None, None, "2020", None]
    count = lambda t, n: f'{{"interactionType": {t}, "userInteractionCount": {n}}}'
    stats = [
        ld('{"interactionStatistic": [%s, %s]}' % (count('"http://schema.org/LikeAction"', 7), count('{"@type": "CommentAction"}', '"1,5"'))), ld('{"@graph": [{"interactionStatistic": %s, "commentCount": 4}]}' % count('"ShareAction"', '"2K"')),
        ld('{"commentCount": "3", "a": "}"}'), ld('{"commentCount": '),
    ]
    assert [tuple(e) for e in each(H.engagement, *stats)] == [(15, 7, None, None), (4, None, 2000, None), (3, None, None, None), (None,) * 4]


def test_word_counts(each):
    texts = ["", None, " ", "a", " a b ", "a\u00a0b\u2003c", "x\n\ny z\t", "one two three four"]
    n = each(lambda x: F.size(X.words(x)), *texts)
    assert each(X.word_count, *texts) == n
    for least in (0, 1, 2, 3, 4):
        assert each(lambda x, least=least: X.has_words(x, least), *texts) == [k >= least for k in n]
