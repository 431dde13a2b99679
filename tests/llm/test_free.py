"""BPE, URL filter, WARC, HTML, classifiers, near duplicates, pipeline."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import bpe, html_text, near_dup, quality_model, shingles, toxicity, url_filter, warc

from .cases import AWKWARD, awkward, nothing, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def reference():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, reference):
    r = random.Random(3)
    odd = ["".join(r.choice("ab \n\t'sSt12.!é漢🙂\u0085\u00a0\x1c<|endoftext|>") for _ in range(r.randint(0, 80))) for _ in range(300)]
    long = " ".join(odd) + "x" * 70_000 + " \n " + prose(20_000, 5)
    rows = [(i, t) for i, t in enumerate([*odd, long, None, "", "<|endoftext|>"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_bpe_round_trip_and_offsets(spark):
    docs = awkward(spark)
    encoded = bpe.encode(docs)
    assert encoded.columns == [*docs.columns, "ids", "starts", "ends"]
    for r in bpe.decode(encoded).collect():
        assert r.decoded_text == (r.text or "") and bytes(r.decoded).decode() == (r.text or "")
        if r.text and len(r.text) < 1000:
            covered = {k for s, e in zip(r.starts, r.ends, strict=True) for k in range(s, e)}
            assert covered == {*range(len(r.text))} and list(r.starts) == sorted(r.starts)
    half = bpe.decode(spark.createDataFrame([([8582],), (None,)], "ids array<int>"))
    assert [x.decoded_text for x in half.collect()] == ["\ufffd", None]
    with pytest.raises(ValueError):
        bpe.decode(bpe.decode(encoded))
    assert bpe.digests(nothing(spark)).count() == 0


def test_url_filter(spark):
    urls = {
        None: ("", "", None, "allow"), "no-scheme.com/xxx": ("", "", None, "block"), "http://A.Example.COM/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "http://b.www.example.com/en/": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://com": ("com", "", None, "allow"), "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/es": ("x.net", "/es", None, "allow"), "http://x.org/spamalot": ("x.org", "/spamalot", None, "allow"), "http://x.org/my-spam": ("x.org", "/my-spam", None, "block"),
        "http://x.org/cheap/cheap": ("x.org", "/cheap/cheap", None, "allow"), "http://x.org/cheap?pills#": ("x.org", "/cheap", None, "block"), "://?a/b": ("", "", None, "allow"), "": ("", "", None, "allow"),
        "a://h#/en/": ("h", "", None, "allow"), "http://x.com/xxx": ("x.com", "/xxx", "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "q") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_awkward(spark):
    long = "http://x.org/" + "spa/" * 50_000 + "free-" * 3 + "xpills"
    rows = [(1, long), (1, long), (2, long + "/win"), (None, "http://x.org/casino"), (3, "HTTP://X.ORG/CASINO"), (4, None), (5, "http://x.org/wetten?gratis")]
    got = Counter((r.page_id, r.verdict, tuple(r.strict), tuple(r.soft)) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == Counter({(1, "allow", (), ("free",)): 2, (2, "block", (), ("free", "win")): 1, (None, "block", ("casino",), ()): 1, (3, "block", ("casino",), ()): 1, (4, "allow", (), ()): 1, (5, "block", (), ("gratis", "wetten")): 1})
    heavy = url_filter.Vocabulary(["bad"], ["odd", "poor"], 3, {"odd": 2})
    judged = lambda url: url_filter.Judge([], heavy)(url)[3]
    assert [judged(u) for u in ("odd", "odd/odd", "odd/poor", "poor", "bad")] == ["allow", "allow", "block", "allow", "block"]


def test_loser_tree():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 15))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda v: v)) == sorted(sum(runs, []))
    numbers = pa.table({"v": [1, 2, 2, 1, 0, 5]})
    assert [[x for (x,) in r] for r in warc.natural_runs(numbers, lambda v: v)] == [[1, 2, 2], [1], [0, 5]]


def test_warc(spark, tmp_path):
    rows = [(7, "http://b.org/x\r\ny", "<p>é</p>"), (3, "http://a.org/", "<p>é</p>"), (9, None, None), (4, "http://a.org/z", ""), (None, "http://a.org/n", "<p>é</p>"), (-5, "http://[bad", "WARC/1.1\r\n\r\n\r\n\r\n"), (11, "u", "x" * 300_000), (11, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/w"
    got = warc.archive(pages, path).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    assert len(got) == len(rows)
    want = Counter()
    for i, _, h in rows:
        data, first = (h or "").encode(), least[h or ""]
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.urlkey, r.ts) for r in sorted(got, key=lambda r: r.position)]
    assert keys == sorted(keys) and sorted(r.position for r in got) == [*range(len(rows))]
    one = next(r for r in got if r.page_id == 3)
    with open(one.file.removeprefix("file:"), "rb") as f:
        f.seek(one.offset)
        assert b"\r\n\r\n<p>\xc3\xa9</p>\r\n\r\n" in f.read(one.length)
    small = warc.records(pages, min_bytes=5).collect()
    assert all(r.record_type == "response" for r in small if r.payload_bytes < 5)
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_bounds_files_and_ranges(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    pages = spark.range(40, numPartitions=3).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/"), F.col("id") % 4).alias("url"), F.repeat(F.col("id").cast("string"), 1 << 20).alias("html"))
    pages = pages.unionByName(pages.limit(1).crossJoin(spark.range(30).select(F.lit(1).alias("_"))).select("page_id", "url", "html"))  # one capture many times
    index = warc.archive(pages, f"file://{tmp_path}/w", file_bytes=5 << 20)
    sizes = [os.path.getsize(f"{tmp_path}/w/{f}") for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    assert max(sizes) <= 6 << 20 and len(sizes) >= 10
    got = warc.merge_runs(index.drop("position"), range_bytes=4000).orderBy("position").collect()
    keys = [(r.urlkey, r.ts, r.page_id, r.file, r.offset) for r in got]
    assert keys == sorted(keys) and [r.position for r in got] == [*range(70)] and {r.payload_bytes for r in got} == {1 << 20, 2 << 20}


def test_warc_finds_damage():
    with pytest.raises(ValueError):
        warc.parse("f", b"nonsense")


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


def test_html(spark):
    story = "<h1>Head &amp; line</h1><p>One\n <b>bold</b>&nbsp;text<p>Two<br>three<script>var a='</p>';</script><ul><li>x<li>y</ul>"
    want = "Head & line\nOne bold text\nTwo three\nx\ny"
    cases = [
        ("http://a.org/1", page(f"<nav>menu</nav><div class=ad>buy</div><article>{story}</article><footer>f</footer>"), want),
        ("http://a.org/2", page(f"<div id='sidebar-left'>s</div><main>{story}<section class='comments'><p>no</p></section></main>"), want),
        ("http://d.org/1", page(f"<div class='wrap has-sidebar'><div class=story>{story}</div></div>"), want),
        ("http://b.org/1", page(f"<div class=wrap><div class=cookie-notice>ok?</div><div class=story>{story}</div></div><form>in<input></form>"), want),
        ("http://b.org/2", page("<div class=wrap><div class=story><p>short</p></div><div class=teasers>" + "<p>a long teaser text of the page</p>" * 9 + "</div></div>"), "short"),
        ("http://b.org/3", page(f"<div class='wrap'><div class=story>{story}</div></div>"), want),
        (None, None, ""), ("http://c.org", "", ""), ("http://c.org", "plain <unclosed", "plain"), ("http://c.org", "<p>a<!-- open", "a"), ("http://c.org", page("<nav>only</nav>"), ""),
        ("http://a.org/1", page(f"<nav>menu</nav><article>{story}</article>"), want),
    ]
    pages = spark.createDataFrame([(i, u, h, "w") for i, (u, h, _) in enumerate(cases)], "page_id long, url string, html string, winners string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i, (u, _, text) in enumerate(cases):
        assert got[i].text == text and got[i].n_chars == len(text) and got[i].url == u, i
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_keeps_articles_whose_class_holds_a_noise_word(spark):
    names = ["newsletter-article", "search-result-article", "widget-content", "post-content notice-board", "comment-free", "entry share", "alert-story"]
    other = '<nav>m</nav><div class="ad-box">buy</div><div class="cookie-notice">ok?</div>'
    rows = [(i, f"http://h{i}.org/", page(f'{other}<div class="{c}"><h1>T</h1><p>a story of many words</p><div class="share-tools">share it</div></div><div class=comments><p>mine</p></div>')) for i, c in enumerate(names)]
    rows += [(50 + i, "http://same.org/", page(f'{other}<div class="promo-story"><p>all pages agree on {i}</p></div><div class="reader-comments"><p>mine</p></div>')) for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "T\na story of many words" for i in range(len(names))), got
    assert all(got[50 + i] == f"all pages agree on {i}" for i in range(3))


def test_html_is_not_taken_in_by_teasers(spark):
    """An article or a main that holds little of a page isn't its text; reader comments go under other names as well."""
    body = " ".join(prose(12, k) + "." for k in range(6))
    card = lambda k: f'<article class="card"><h2>Card {k}</h2><p>{prose(6, k)}</p></article>'
    rows = [
        (1, "http://a.org/1", f'<body><main><p>{body}</p></main><article class="teaser"><p>short teaser</p></article></body>', body),
        (2, "http://b.org/1", f'<body><div class="story"><p>{body}</p><p>{body}</p></div><div class="more">{card(1)}{card(2)}{card(3)}</div></body>', f"{body}\n{body}"),
        (3, "http://c.org/1", f'<body><article><p>{body}</p><div class="responses"><p>{prose(30, 1)}</p></div><section id="respond"><p>{prose(20, 2)}</p></section></article></body>', body),
        (4, "http://d.org/1", f'<body><main><p>tiny</p></main><div id="story"><p>{body}</p></div></body>', body),
        (5, "http://e.org/1", f'<body><article><p>{body}</p></article><div><p>{prose(20, 3)}</p></div></body>', body),
        (6, "http://f.org/1", f'<body><article><p>{body}</p><p hidden>kept</p></article></body>', f"{body}\nkept"),
    ]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_html_leaks_no_markup(spark):
    broken = {
        '<p title="unclosed>one</p><p>two</p>': "one\ntwo", "<p title='x>one</p><p class=\"a\">two</p>": "one\ntwo", '<p title="a > b">one</p>': "one", "a < b <c": "a < b", "1 <2> 3": "1 <2> 3", "<": "<", "</": "",
        "<script>a </scripty> <b>c</b> </script x='1'>b": "b", "<!-- a --> b <!doctype> c <? d > e </ f> g": "b c e g", "x<style>p{}": "x", "&lt;p&gt; &amp;amp; &#233; &bogus;": "<p> &amp; é &bogus;",
        "<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f<tr><td>g</table>": "a\nb\nc\nd\ne\nf\ng", "<b>a<p>b</b>c</p>d": "a\nbc\nd", "\x00a\u2003b\x85c": "\x00a b c",
    }
    pages = spark.createDataFrame([(i, f"http://{i}.org", h) for i, h in enumerate(broken)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert [got[i] for i in range(len(broken))] == list(broken.values())


def test_html_is_linear():
    import time

    html_text.Page("<div><p>" * 3000 + "x" * 10 + "<" * 20000 + "<!-- " * 2000).text([])
    make = [
        lambda n: "<div>" * n + "x", lambda n: "<a " * n + '"', lambda n: '<a "x>" ' * n + '"', lambda n: "<ul><li><ul>" + "<div>" * n + "<li></li>" * n, lambda n: "<div>" + "<b>" * n + "<p></p>" * n,
        lambda n: "<div>" * n + "</span>" * n, lambda n: "<script>" + "</script" * n, lambda n: '<div class="a b1 comment">' * n + "x", lambda n: "<!-- " * n, lambda n: "<p " + "class=" * n, lambda n: "&" * n + "<",
    ]
    for k, f in enumerate(make):
        took = []
        for n in (25_000, 100_000):
            start = time.process_time()
            html_text.Page(f(n)).text([])
            took.append(time.process_time() - start)
        assert took[1] < 5 and took[1] < 10 * took[0] + 0.3, (k, took)


def naive_text(html):
    """The first article by Python's own parser, block by block."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        inside, skipped, blocks, now = 0, 0, [], ""

        def end_block(self):
            if self.now.split():
                self.blocks.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.now += " "
            elif tag not in ("a", "b", "i", "em", "strong", "span"):
                self.end_block()
            self.inside += tag == "article"
            self.skipped += tag in ("script", "style", "nav", "footer", "form") or ("class", "ad") in attrs

        def handle_endtag(self, tag):
            if tag not in ("a", "b", "i", "em", "strong", "span"):
                self.end_block()
            self.inside -= tag == "article"
            self.skipped -= tag in ("script", "style", "nav", "footer", "form")

        def handle_data(self, data):
            if self.inside and not self.skipped:
                self.now += data

    parser = Article()
    parser.blocks = []
    parser.feed(re.sub(r'<div class="ad">.*?</div>', "", html or "", flags=re.S))
    parser.close()
    parser.end_block()
    return "\n".join(parser.blocks)


def test_html_equals_naive_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(html) and all(r.text == naive_text(html[r.page_id]) and r.n_chars == len(r.text) for r in got)


def labelled(spark, n, good, bad, seed):
    r = random.Random(seed)
    rows = [(i, bad(i) if y == 0 else good(i), y) for i in range(n) for y in [int(r.random() < 0.6)]]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def test_toxicity_and_quality(spark):
    docs, labels, truth = labelled(spark, 600, lambda i: prose(60, i).capitalize() + ".", lambda i: (prose(40, i) + " idiotic moron").upper() + "!! ***", 1)
    for got, held, of, right in ((toxicity.score(docs, labels), 2, 4, lambda y: 1 - y), (quality_model.score(docs, labels), 1, 3, lambda y: y)):
        rows = got.collect()
        assert len(rows) == 600
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == held) and 0 <= r.score <= 1 for r in rows)
        unseen = [r.predicted == right(truth[r.doc_id]) for r in rows if r.held_out]
        assert sum(unseen) > 0.97 * len(unseen)


def test_quality_model_reads_whole_tokens():
    s = quality_model.Settings()
    place, vectors = quality_model.word_vectors(["alpha beta/gamma " * 3, "漢" * 24 + "字" * 24, "", "a-b"], s)
    model = quality_model.Model(place, vectors, (), 1.0)
    assert {"w:alpha", "w:beta", "w:gamma", "w:b", "w:" + "字" * 24} <= place.keys()
    assert quality_model.shapes_of("a/" * 6) == ["x/x/x/x/", "x/x/"] and quality_model.words_of("don't") == ["don", "t"]
    far = lambda a, b: abs(model.pooled(a) - model.pooled(b)).max() > 1e-3
    assert far("alpha/beta", "alpha/zzz") and far("漢" * 24 + "字" * 24, "漢" * 48) and far("x" * 30, "x" * 30 + "!!gamma")
    assert not far("alpha beta", "beta alpha") and not model.pooled(" ").any()


def test_classifiers_take_awkward_tables(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(8, 1, 1), (9, 0, 0), (2, 1, None), (None, 1, 1), (8, 0, 1), (6, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for own in (toxicity, quality_model):
        for some in (labels, labels.limit(0)):
            got = own.score(docs, some).collect()
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in AWKWARD) and all(0 <= r.score <= 1 for r in got)
        assert own.score(nothing(spark), labels).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark, 300, lambda i: prose(30, i), lambda i: prose(30, i) + " moron", 2)
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.score(docs, labels).collect()) == sorted(toxicity.score(docs, turned).collect())


def test_held_out_quality_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark, 200, lambda i: prose(30, i), lambda i: prose(30, i).upper(), 3)
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_model.score(docs, labels).collect()) == sorted(quality_model.score(docs, turned).collect())


def test_samples(spark):
    from corpuslab.llm.sample import training_sample, unlabelled_sample

    docs = spark.createDataFrame([(i, "x" * (i % 7) + f" {i}") for i in range(400)] + [(None, "none"), (3, "again"), (900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200)] + [(4, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    known = training_sample(docs, labels, "toxic", 4, 2, 10_000, 9).to_pylist()
    want = Counter((t, max(i % 2, int(i == 4))) for i, t in [(i, "x" * (i % 7) + f" {i}") for i in range(200)] + [(3, "again")] if fold(i) != 2 and len(t) <= 9)
    assert Counter((r["text"], r["label"]) for r in known) == want
    free = unlabelled_sample(docs, labels, "toxic", 4, 2, 10_000, 9).to_pylist()
    assert Counter(r["text"] for r in free) == Counter(t for i, t in [(i, "x" * (i % 7) + f" {i}") for i in range(200, 400)] if fold(i) != 2 and len(t) <= 9)
    short = training_sample(docs, labels, "toxic", 4, 2, 20, 7)  # long texts are out before rows are counted
    assert short.num_rows == 20 and unlabelled_sample(docs, labels, "toxic", 4, 2, 20, 7).num_rows == 20


def test_risk_equals_plain_restatement():
    import math

    import numpy as np

    r = np.random.default_rng(3)
    for prior in (0.1, 0.6):
        f = r.normal(0, 2, 12)
        p, u = np.array([1.0] * 4 + [0.0] * 8) / 4, np.ones(12) / 12

        def plain(f):
            loss = lambda z: math.log(1 + math.exp(-z))
            pos = sum(loss(f[i]) for i in range(4)) / 4
            rest = sum(loss(-z) for z in f) / 12 - prior * sum(loss(-f[i]) for i in range(4)) / 4
            return prior * pos, rest

        value, g = toxicity.risk(f, p, u, prior)
        pos, rest = plain(f)
        assert math.isclose(value, pos + max(0, rest))
        for i in range(12):
            h = np.zeros(12)
            h[i] = 1e-6
            (pa_, ra), (pb, rb) = plain(f + h), plain(f - h)
            slope = (pa_ + ra - pb - rb) / 2e-6 if rest >= 0 else -(ra - rb) / 2e-6
            assert abs(g[i] - slope) < 1e-6
    assert any(toxicity.risk(z := r.normal(3, 1, 12) * np.array([1] * 4 + [-9] * 8), p, u, 0.6)[0] == 0.6 * (p @ np.logaddexp(0, -z)) for _ in range(50))  # the turned side was there
    x = toxicity.Rows([np.array([0, 2]), np.array([], int), np.array([1])], 4)
    assert x.times(np.array([1.0, 2, 4, 8])).tolist() == [5, 0, 2] and x.back(np.array([1.0, 2, 3])).tolist() == [1, 3, 1, 0]


def test_word_vectors_equal_plain_restatement():
    import numpy as np

    s = quality_model.Settings(vocabulary=6, shapes=3, dimensions=16)
    texts = ["Alpha beta beta gamma", "delta alpha, BETA alpha gamma!!", "x"]
    place, vectors = quality_model.word_vectors(texts, s)
    index = {t: quality_model.index_vector(t, s) for t in place}
    terms = lambda token: [t for t in [*("w:" + w for w in quality_model.words_of(token)), *("s:" + x for x in quality_model.shapes_of(token))] if t in place]
    context = {t: index[t].astype(float) for t in place}
    for text in texts:
        tokens = text.split()
        near = [sum((index[t] for t in terms(tok)), np.zeros(16)) + (index["="] if k and tokens[k - 1] == tok else 0) for k, tok in enumerate(tokens)]
        for k, tok in enumerate(tokens):
            for t in set(terms(tok)):
                for j in range(max(0, k - 2), min(len(tokens), k + 3)):
                    context[t] += near[j] if j != k else 0
    for t, i in place.items():
        want = context[t] / max(np.linalg.norm(context[t]), 1e-6) + index[t] / np.sqrt(s.nonzero)
        assert np.allclose(vectors[i], want, atol=1e-5), t
    w = quality_model.train(x := np.random.default_rng(1).normal(size=(60, 16)), y := (x[:, 0] > 0).astype(float), s)
    assert (((np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]) > 0) == y).mean() > 0.95


def brute_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(docs, percent=85):
    """doc_id to (size, component), by counting common members through an inverted index."""
    sets = {i: brute_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for m in sets[i] for j in index[m])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for m in sets[i]:
            index[m].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_sets_equal_brute_force():
    r = random.Random(5)
    texts = ["".join(r.choice("aBé \n\x0b漢") for _ in range(r.randint(0, 60))) for _ in range(500)] + [None, "", " ", "a"]
    got = shingles.sets(pa.array(texts))
    assert [len(x) for x in got] == [len(brute_set(t)) for t in texts]
    assert Counter(map(shingles.fingerprint, got)).most_common(3)[0][1] == Counter(map(brute_set, texts)).most_common(1)[0][1]
    assert [x.tolist() for x in shingles.sets(pa.array(texts).slice(100, 50))] == [x.tolist() for x in got[100:150]]
    piece, shingles.PIECE = shingles.PIECE, 64
    try:
        assert [x.tolist() for x in shingles.sets(pa.array(texts))] == [x.tolist() for x in got]
    finally:
        shingles.PIECE = piece


def families(seed):
    """Chains, stars and copies around the threshold."""
    r = random.Random(seed)
    out, k = [], 0
    for f in range(25):
        base = prose(r.choice([4, 5, 30, 90, 200]), 1000 + f).split()
        for _ in range(r.randint(1, 24)):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                own[r.randrange(len(own))] = f"new{r.random()}"
            if r.random() < 0.3:
                base = own
            out.append((k, " ".join(own)))
            k += 1
    r.shuffle(out)
    return out


@pytest.mark.parametrize("members", [1024, 8])
def test_near_duplicates_equal_brute_force(spark, members):
    rows = families(members)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.clusters(docs, near_dup.Settings(members=members)).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) < 0.8 * len(rows)


def test_every_pair_under_the_distance_shares_a_key(spark):
    """Twelve wrong positions in six chunks, and as many as the distance allows, dealt out in every way that a seed gives."""
    import numpy as np

    r = np.random.default_rng(4)
    rows = []
    for k in range(200):
        sig = r.integers(0, 1 << 16, near_dup.POSITIONS)
        other = sig.copy()
        if k < 100:
            wrong = [c * near_dup.CHUNK + p for c in r.permutation(near_dup.CHUNKS)[:6] for p in r.permutation(near_dup.CHUNK)[:2]]
        else:
            wrong = r.permutation(near_dup.POSITIONS)[: near_dup.MAX_DISTANCE]
        other[wrong] ^= 1
        rows += [(2 * k, 100, bytearray(sig.astype("<u2").tobytes())), (2 * k + 1, 100, bytearray(other.astype("<u2").tobytes()))]
    classes = spark.createDataFrame(rows, "label long, n long, sig binary")
    met = near_dup._blocks(near_dup._keyed(classes), near_dup.Settings()).join(classes, "label")
    assert near_dup._with_candidates(met, near_dup.Settings()).select("label").distinct().count() == 400


def families(seed=3):
    """Copies of several texts, spoiled in one to six places, so that not all of a family are near each other; some of them drift, each from the one before."""
    r, rows = random.Random(seed), []

    def spoil(words, n):
        words = [*words]
        for _ in range(n):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
        return words

    for f in range(4):
        base = prose(300, 50 + f).split()
        last = base
        for _ in range(60):
            last = spoil(last if f == 1 else base, r.choice([1, 1, 2, 3]) if f == 1 else r.choice([1, 2, 3, 4, 6]))
            rows.append((r.randint(0, 10**9), " ".join(last)))
    rows += [(r.randint(0, 10**9), prose(100, 900 + k)) for k in range(40)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot, pivots, rounds, members", [(10, 1, 1, 8), (10, 3, 2, 16), (40, 2, 2, 8), (10, 2, 0, 8)])
def test_hot_keys_equal_brute_force(spark, hot, pivots, rounds, members):
    rows = families()
    s = near_dup.Settings(hot=hot, pivots=pivots, rounds=rounds, members=members)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.clusters(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()}
    want = brute_components(rows)
    assert got == want and 40 < len({c for _, c in want.values()}) < len(rows) - 100


def test_hot_keys_make_work_in_proportion(spark):
    """Stars, then only what is outside a key's largest component: rows of units grow with the members of a family that is one component."""
    s = near_dup.Settings(hot=50, members=16)
    n_rows = []
    for n in (200, 800):
        hot = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("pos"), F.col("id").alias("label"), F.lit(100).cast("long").alias("n"), F.col("id").alias("comp"))
        stars = near_dup._stars(hot, 0, s)
        assert "Window" not in stars._jdf.queryExecution().executedPlan().toString()
        joined = hot.withColumn("comp", F.when(F.col("label") < n - 5, F.lit(0)).otherwise(F.col("label")).cast("long"))  # five are outside
        rest = near_dup._rest(joined, near_dup._open_keys(joined, s), s)
        n_rows.append((stars.count(), rest.count()))
        met = {tuple(sorted((a, b))) for unit in units_of(rest) for a in unit for b in unit if a != b}
        assert all((a, b) in met for a in range(n - 5) for b in range(n - 5, n)) and all((a, b) in met for a in range(n - 5, n) for b in range(a + 1, n))
        assert near_dup._open_keys(hot.withColumn("comp", F.lit(0).cast("long")), s).count() == 0
        assert near_dup._open_keys(joined, s).first().copies == rest.count()
    assert n_rows[1][0] < 4.5 * n_rows[0][0] and n_rows[1][1] < 4.5 * n_rows[0][1]


def units_of(df):
    """Labels that meet: of a unit of two blocks, those of both."""
    out = defaultdict(list)
    for r in df.collect():
        out[r.key, r.i, r.j].append(r.label)
    return out.values()


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_dup.clusters(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_near_duplicates_awkward(spark):
    docs = awkward(spark)
    got = near_dup.clusters(docs)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[9].component_id == 8 and not by_id[9].kept and by_id[8].kept and by_id[None].kept and by_id[None].component_id is None
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (1, 2, 3))
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in AWKWARD if r[0] != 9)
    assert near_dup.clusters(nothing(spark)).count() == 0


def test_components(spark):
    from corpuslab.llm.components import components

    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(150)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {x for a, b in edges for x in (a, b)} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k not in loops}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, last, SF).cache()
        assert out.columns == docs.columns and out.count() <= last.count(), name
        last = out
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == last.count() > 0


def test_pipeline_takes_awkward_rows(spark):
    """Null, empty, long, repeated rows and clashing columns through every stage, each on all rows and on what its predecessor kept."""
    import corpus_pipeline

    rows, docs = [r[0] for r in AWKWARD], awkward(spark)
    alone = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    assert all(out.columns == docs.columns for name, out in alone.items() if name != "bpe")
    ids = {name: Counter(r.doc_id for r in out.collect()) for name, out in alone.items()}
    assert {*ids["quality_rules"]} <= {6, 8, 9, None} and ids["line_dedup"] == ids["decontamination"] == ids["bpe"] == Counter(rows) and ids["near_dup"] == Counter(i for i in rows if i != 9)
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        last = stage(spark, last, SF).cache()
        assert {r.doc_id for r in last.select("doc_id").collect()} <= {*rows}, name
    assert {r.doc_id for r in last.collect()} >= {6, 8}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing(spark), SF).count() == 0, name


def test_pipeline_stages_equal_brute_force(spark, reference):
    """The stages that SQL can't express, each on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i, (_, c) in brute_components(rows.items()).items() if i == c}
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        assert r.n_tokens == len(reference.encode_ordinary(rows[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
