"""Quality rules, decontamination, line dedup."""

import math
import re
from collections import Counter

from corpuslab.llm import decontamination, line_dedup, quality_rules

from .cases import AWKWARD, awkward, nothing, prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = SPACE.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if count[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_base_rules(spark):
    extra = [(20 + i, t, "en", "c", 0) for i, t in enumerate(["a b c a b c", "a a a a", "a b c x a b c y b c", "x\n\nx\n x\nx", "# b | c\n" * 30, "\x0b\x0c\r a"])]
    docs = spark.createDataFrame([*AWKWARD, *extra], awkward(spark, False).schema)
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(docs).collect()}
    assert len([*AWKWARD, *extra]) - 1 == len(got)
    for doc_id, text, *_ in [*AWKWARD, *extra]:
        want = base(text)
        r = got[doc_id, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, doc_id
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_divergence(spark):
    good = [(i, "the and of " + prose(120, i) + " is in the", "en", "s", 0) for i in range(40)]
    bad = [(100, " ".join(w + "***%%%" for w in prose(120, 3).split()), "en", "s", 0), (101, "THE END!! " * 60 + prose(200, 5).upper(), "en", "s", 0)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(good + bad, awkward(spark, False).schema)).collect()}
    assert all(got[i].kept for i in range(40)) and not got[100].kept and not got[101].kept
    assert got[100].char_distance > 0.3 > got[0].char_distance


def test_no_texts_are_held(spark):
    """What is held while verdicts are found is small beside the texts, and is gone when the result is there."""
    docs = spark.createDataFrame([(i, "the and of " + prose(2000, i), "en", "s", 0) for i in range(30)] + [(50, "***", "en", "s", 0)], awkward(spark, False).schema)
    measured, _ = quality_rules._judged(docs, [quality_rules.F.lit("k" * 32).alias("_q_key")], "text", "lang", quality_rules.Rules())
    measured.count()
    infos = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    assert sum(x.diskSize() for x in infos) < 31 * 1000
    measured.unpersist(True)
    kept = quality_rules.keep_good(docs)
    assert not spark.sparkContext._jsc.sc().getRDDStorageInfo() and {r.doc_id for r in kept.collect()} == {*range(30)}


def test_pipeline_rejects_texts_without_common_words(spark):
    import corpus_pipeline

    english = "the of and to in is that it was for on are as with be this have not at a".split()
    foreign = "der die und das von mit sich auf für ist nicht ein eine dem den des im zu".split()
    text = lambda common, i: " ".join(w if k % 3 else common[(i + k) % len(common)] for k, w in enumerate(re.sub("[0-9]+|of|the|and|to|in ", "xo", prose(150, i)).split()))
    rows = [(i, text(english, i), "en", "s", 0) for i in range(40)] + [(100 + i, text(foreign, i), "en", "s", 0) for i in range(2)]
    docs = spark.createDataFrame([*rows, (200, text(foreign, 3), "xx", "s", 0), (300, text(foreign, 4), "de", "s", 0), (301, text(foreign, 5), "de", "s", 0)], awkward(spark, False).schema)
    loose = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(loose[i].char_distance < 0.3 and loose[i].kept for i in (100, 101))  # by the limit of op8
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert kept == {*range(40), 200, 300, 301}
    # A language whose texts have no common word at all has nothing to go by.
    bare = spark.createDataFrame([(i, text(["qua"], i), "en", "s", 0) for i in range(5)], docs.schema)
    assert corpus_pipeline.quality(spark, bare, "").count() == 5


def test_distance_by_hand(spark):
    from pyspark.sql import functions as F

    p, q = [1.0, 3.0, 0.0], [2.0, 2.0, 4.0]
    d = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"), quality_rules.js_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("e")).first()
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(*a, strict=True) if x)
    assert math.isclose(d.d, math.sqrt((kl((p, q)) + kl((q, p))) / 2)) and d.e == 0


def test_quality_keeps_columns(spark):
    docs = awkward(spark)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} <= {6, 8, 9, None}
    assert quality_rules.keep_good(nothing(spark)).count() == 0 and quality_rules.judge(nothing(spark)).count() == 0


def contamination(docs, items, n=13):
    words = lambda t: TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [(i, g) for i, t in items for w in [words(t)] if w for g in {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= {*range(k, k + len(g))}
                    found.add(str(item))
        out.append((doc_id, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_decontamination(spark):
    items = [(1, prose(30, 2)), (2, prose(30, 2)), (3, "Short ITEM"), (4, ""), (5, None), (10, prose(13, 4)), (11, "x"), (None, prose(14, 6))]
    texts = [(20, "a " + prose(30, 2) + " b"), (21, prose(200, 8) + " short, item! " + prose(20, 4)), (22, "short item short item"), (23, prose(300, 11) + " X"), (24, " ".join(prose(30, 2).split()[5:17])), (25, "so " + prose(14, 6))]
    docs = spark.createDataFrame([*AWKWARD, *[(i, t, "en", "z", 0) for i, t in texts]], awkward(spark, False).schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination([(r[0], r[1]) for r in AWKWARD] + texts, [x for x in items if x[0] is not None])
    for most in (200_000, 0):  # broadcast and joined
        got = decontamination.report(docs, bench, max_broadcast=most).collect()
        plain = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in got if r.doc_id != 25)
        assert plain == Counter({k: v for k, v in want.items() if k[0] != 25})
        odd = next(r for r in got if r.doc_id == 25)  # only an item without an id
        assert odd.n_hit == 14 and not odd["items"] and odd.contaminated
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {20, 22, 24} == {24}
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[20] == "a  b" and cut[22] == "" and cut[24] == texts[4][1]


def test_short_items_meet_their_own_words_only(spark):
    """A one-word item does not make longer items meet every place of their first word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.createDataFrame([(1, "the"), (2, "the quite unheard of"), (3, "Of the"), (4, "of"), (5, prose(13, 3))], "item_id long, text string")
    hits, grams = decontamination.occurrences(docs, bench)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
    words = [TOKEN.findall((r.text or "").lower()) for r in docs.select("text").collect()]
    ends = lambda g: sum(tuple(w[k : k + len(g)]) == g for w in words for k in range(len(w)))
    named = {r.gram_id: tuple(r.gram) for r in grams.collect()}
    got = Counter(named[r.gram_id] for r in hits.select("gram_id").collect())
    assert got == +Counter({g: ends(g) for g in named.values()}) and got[("the",)] > 0
    assert decontamination.report(docs, bench).filter("size(items) > 3").count() == 0


def test_decontamination_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = awkward(spark)
    assert decontamination.report(docs, bench).filter("n_hit > 0 or contaminated").count() == 0
    assert decontamination.decontaminate(docs, bench).count() == len(AWKWARD)
    assert decontamination.report(nothing(spark), bench).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"menu \nown line {i}\n\nown line {i}", "en", "h", None) for i in range(20)] + [(50 + i, f"menu\nrare\n{i}" if i < 2 else f"{i}", "en", "g", None) for i in range(40)]
    rows += [(200 + i, "copied page\nmenu", "en", "h", None) for i in range(50)] + [(300, None, None, None, None), (301, "", None, None, None)]
    docs = spark.createDataFrame(rows, awkward(spark, False).schema)
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[3] == "own line 3\n\nown line 3" and got[50] == "menu\nrare\n0" and got[200] == "copied page" and got[300] is None and got[301] == ""
    n = {r.doc_id: r.n_dropped for r in line_dedup.report(docs).collect()}
    assert n[3] == 1 and n[50] == 0 and n[300] == 0


def test_pipeline_drops_lines_below_a_tenth(spark):
    import corpus_pipeline

    foot = lambda i: "\nfooter" if i < 5 else "\ntwice" if i < 7 else ""
    docs = spark.createDataFrame([(i, f"own line {i}{foot(i)}", "en", "h", None) for i in range(200)], awkward(spark, False).schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert all(got[i] == f"own line {i}" for i in range(5)) and got[5] == "own line 5\ntwice"
    assert all(r.n_dropped == 0 for r in line_dedup.report(docs).collect())  # by the share of op5


def test_line_dedup_awkward(spark):
    docs = awkward(spark)
    out = line_dedup.drop_boilerplate(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in AWKWARD)
    assert line_dedup.drop_boilerplate(nothing(spark)).count() == 0
