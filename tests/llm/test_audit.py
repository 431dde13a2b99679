"""Source audit, spelling variants, document fingerprints: against brute force, on awkward rows, and by plan."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpuslab.llm import fingerprints, source_audit, spelling

from .cases import AWKWARD, awkward, nothing, prose

SF = "/root/testdata/sf0.001"
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(UPPER))
        counts[lang, source].update(found)
        docs[lang].update({*found})
        groups[lang].add(source)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []

    def ranked(lang, source, part, values, most):
        for k, (value, item) in enumerate(sorted(((v, i) for i, v in values.items()), key=lambda x: (-x[0], x[1].encode()))[:most]):
            out.append((lang, source, part, item, value, k + 1))

    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        shares = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept})(sum(c[t] for t in kept))
        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            ranked(lang, s, "pair", {o: sum(f(own[s][t], own[o][t]) for t in kept) for o in sources if o != s}, None)
            ranked(lang, s, "term", {t: f(own[s][t], whole[t]) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]}, top)
    return sorted(out)


def test_source_audit_equals_brute_force(spark):
    r = random.Random(4)
    words = [*"the The of ÉA éa 漢字 x1y don't \U0001f642 ß".split(), *map(chr, range(0x61, 0x6B))]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "é", None])) for _ in range(300)]
    rows += [("the the", "en", "s1")] * 50 + [(None, "en", "mute"), ("alone", "xx", "a"), ("", "xx", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "p": F.lit(0), "v": F.lit(0)})
    want = brute_audit(rows)
    for members in (256, 2):  # one block, and several
        got = source_audit.audit(docs, source_audit.Settings(members=members))
        assert sorted(map(tuple, got.collect())) == want
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {r for r in want if r[0] == "xx"} == {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)}


def test_source_audit_emits_corrections_only(spark):
    """Terms that two sources have equally often come to zero; shares beyond 64 bits are exact."""
    big = 20_000_000_000
    one = spark.range(1).select(source_audit.share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p"), source_audit.share(F.lit(0), F.lit(0), F.lit(1)).alias("z")).first()
    assert one.p == 1 + 10**9 * (big + 2) // (3 * big + 14) and one.z == 1 + 10**9
    docs = spark.createDataFrame([(" ".join(f"w{chr(97 + i)}" for i in range(9)), "en", s) for s in "abc" for _ in range(12)], "text string, lang string, source string")
    assert source_audit.pairs(source_audit.index(docs)).select("value").distinct().collect()[0].value == 0


def test_source_audit_awkward(spark):
    rows = [(r[1], r[2], r[3]) for r in AWKWARD]
    got = source_audit.audit(awkward(spark), source_audit.Settings(min_docs=2))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 2)
    assert source_audit.audit(nothing(spark)).count() == 0


RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def one_edit(w):
    letters = [*map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x100))]
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return out - {w}


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: {x for x in one_edit(w) if x in n} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def as_rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_spelling_equals_brute_force(spark):
    r = random.Random(8)
    base = ["".join(r.choice("aeiouàéÀßlmnrstdÿ×") for _ in range(r.randint(6, 12))) for _ in range(40)]

    def spoil(w):
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeioué") + w[i:], w[:i] + r.choice("aeioué") + w[i + 1 :]])
        return w.title() if r.random() < 0.2 else w

    rows = [(i, " ".join(spoil(r.choice(base)) + r.choice(["", ",", "1", "ž", "-"]) for _ in range(60))) for i in range(120)]
    chain = ["abcdefgh"] * 4000 + ["abcdefg"] * 390 + ["abcdefgg"] * 37 + ["abcdefggg"] * 3  # forms of forms
    rows += [(None, None), (500, ""), (501, " ".join(chain)), (501, " ".join(chain)), (502, "q" * 40_000 + " " + "q" * 40_001), (503, "q" * 40_000 + " " + "q" * 40_001)]
    want = brute_variants([x for x in rows if x[0] not in (502, 503)])
    got = as_rows(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(0))))
    assert [x for x in got if len(x[0]) < 30_000] == want and sum(len(x[0]) > 30_000 for x in got) >= 2
    assert sum(x[1] != "" for x in want) > 30 and max(x[4] for x in want) > 5
    assert dict((x[0], x[2]) for x in want)["abcdefggg"] == "abcdefgh"


def test_spelling_equals_brute_force_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert as_rows(spelling.variants(docs)) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_spelling_bands(spark):
    """One edit flips at most two bits of the mask, so a band is equal."""
    r = random.Random(2)
    letters = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
    assert len(set(spelling.BITS[:26])) == 26 and max(spelling.BITS) < 60
    pairs = []
    for _ in range(400):
        w = "".join(r.choice(letters) for _ in range(r.randint(7, 20)))
        i = r.randrange(len(w))
        pairs.append((w, r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])))
    a, b = spelling.mask(F.col("a")), spelling.mask(F.col("b"))
    equal = sum((spelling.band(a, k) == spelling.band(b, k)).cast("int") for k in range(3))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", a.alias("m"), F.bit_count(a.bitwiseXOR(b)).alias("bits"), equal.alias("equal")).collect()
    assert max(x.bits for x in got) == 2 and min(x.equal for x in got) == 1

    def restated(w):
        m = 0
        for c in w:
            m ^= 1 << spelling.BITS[ord(c) - 0x61 if c < "\x80" else ord(c) - 0xC0 + 26]
        return m

    assert all(x.m == restated(x.a) for x in got)


def test_spelling_awkward(spark):
    assert as_rows(spelling.variants(awkward(spark))) == brute_variants([(r[0], r[1]) for r in AWKWARD])
    assert spelling.variants(nothing(spark)).count() == 0


def brute_edited(rows):
    """By falling id, then MD5; rows of equal id and text are one document."""
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5(x[1].encode()).hexdigest()))
    out = {}
    for k, (i, t) in enumerate(distinct):
        nxt = distinct[(k + 1) % len(distinct)][1]
        cut = len(t) // 3
        out[i, t] = t[: len(t) - cut] + nxt[:cut]
    return out


def ran(spark, df):
    """The plan that ran, without broadcasts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = df.select("*")
        again.collect()
        return again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_fingerprints_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_edited(rows)
    found = fingerprints.edited(docs)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", found._jdf.queryExecution().executedPlan().toString())
    assert re.search(r"ReusedExchange|Reused Exchange", ran(spark, found))  # texts are shuffled once
    near = lambda c: fingerprints.likeness(F.col("fingerprint"), F.col(c))
    got = found.select("*", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"), fingerprints.edited_span(F.col("fingerprint"), F.col("edited_fingerprint")).alias("span")).collect()
    assert {(r.doc_id, r.text): r.edited for r in got} == want and len(got) == len(rows)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text].add(r.fingerprint)
        by_text[r.edited].add(r.edited_fingerprint)
        assert (r.near_edited == 1) == (r.text == r.edited) and 0 <= r.near_next <= 1
        if r.text != r.edited:
            # the span holds every change, and begins with the paragraph of the first one
            first = next((k for k, (a, b) in enumerate(zip(r.text, r.edited, strict=False)) if a != b), min(len(r.text), len(r.edited)))
            assert r.span.first <= first and r.text[r.span.first : first].count("\n") <= 0 and r.text[r.span.last :] == (r.edited[len(r.edited) - len(r.text) + r.span.last :] if r.span.last < len(r.text) else "")
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)
    long = [r for r in got if len(r.text) > 600 and r.text != r.edited]
    assert sum(r.near_edited for r in long) / len(long) > 0.55 > 0.2 > sum(r.near_next for r in long if r.near_next < 1) / len(long)


def tree_of(text):
    """root and (section nodes, paragraphs' hashes) restated."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sections, now = [], []
    for p in re.findall(r"[^\n]*\n|[^\n]+", text):
        now.append(sha(p))
        if now[-1][0] in "08" or not p.strip(" \r\n\t"):
            sections.append(now)
            now = []
    sections += [now] if now else []
    nodes = [sha("".join(s)) for s in sections]
    return sha("".join(nodes)), [n[:16] for n in nodes], [[h[:16] for h in s] for s in sections]


def test_fingerprint_tree(spark):
    texts = ["", "one", "a\nb\n", "a\nb", "a\n\nb\n", "\n\n", *[t for _, t, *_ in AWKWARD if t], "\n".join(prose(12, i) for i in range(60))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.fingerprint(F.col("t")).alias("fp")).collect()
    for r in got:
        root, body = r.fp.split("|")
        sections = [s.split(":") for s in body.split(";") if s]
        assert (root, [s[0] for s in sections], [[p.split("-")[0] for p in s[1].split(",")] for s in sections]) == tree_of(r.t)
        assert sum(int(p.split("-")[1].split(".")[0]) for s in sections for p in s[1].split(",")) == len(r.t)
    assert len({r.fp for r in got}) == len(set(texts))


def test_edits_are_located(spark):
    lines = [prose(15, i) + "\n" for i in range(80)]
    changed = lines.copy()
    changed[40] = "another line\n"
    cases = {"same": lines, "one": changed, "inserted": [*lines[:10], "new\n", *lines[10:]], "deleted": lines[:30] + lines[33:], "none": []}
    rows = [(k, "".join(lines), "".join(v)) for k, v in cases.items()]
    fp = lambda c: fingerprints.fingerprint(F.col(c))
    df = spark.createDataFrame(rows, "k string, a string, b string").withColumns({"x": fp("a"), "y": fp("b")})
    got = {r.k: r for r in df.select("k", fingerprints.likeness(F.col("x"), F.col("y")).alias("near"), fingerprints.edited_span(F.col("x"), F.col("y")).alias("s")).collect()}
    at = lambda i: len("".join(lines[:i]))
    assert got["same"].near == 1 and got["same"].s is None and got["none"].near == 0 and (got["none"].s.first, got["none"].s.last) == (0, at(80))
    assert (got["one"].s.first, got["one"].s.last, got["one"].s.paragraphs) == (at(40), at(41), 1) and 0.95 < got["one"].near < 1
    assert got["inserted"].s.first == got["inserted"].s.last == at(10) and got["inserted"].s.paragraphs == 0
    assert (got["deleted"].s.first, got["deleted"].s.last) == (at(30), at(33))


def test_fingerprints_awkward(spark):
    rows = [(r[0], r[1]) for r in AWKWARD]
    want = brute_edited(rows)
    got = fingerprints.edited(awkward(spark)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t in rows)
    assert all(r.edited == want[r.doc_id, r.text] for r in got)
    assert fingerprints.edited(nothing(spark)).count() == 0 and fingerprints.fingerprints(nothing(spark)).count() == 0
    alone = fingerprints.edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert alone.edited == "abcdab" and alone.next_fingerprint == alone.fingerprint
    null, empty = fingerprints.fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert null.fingerprint == empty.fingerprint and null.n_chars == 0
