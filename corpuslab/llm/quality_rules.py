"""Quality rules: divergence of a document's histograms from its language's reference (DataFrame functions only).

Each document gets two histograms: its characters by class, and its words by common word of its language. The reference
of a language is the sum of these histograms over *all* documents of that language that pass the base rules. A document is rejected if
the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) to its reference exceeds a limit, unless it is
too short for the histogram to mean anything, or if a base rule fails.

Cases: null or empty text has no words, all counts 0, and fails the base rule. A null language is a language of its own, and so is an empty one.
A language without a list of common words is judged by characters only; one without a document that passes the base rules has no reference, and none of its documents is kept.
Repeated rows count each, are judged alike, one result each. A distance equal to a limit is kept (ties). Long texts are read whole; what is counted of them is some forty integers.
An empty table gives an empty result. Extra columns pass through ``keep_good``; ``judge`` returns only its own columns beside those asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold_for, let, materialise, settings, small

# The most common function words of four languages.
COMMON_WORDS = {
    "de": ["auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "at", "be", "for", "have", "in", "is", "it", "not", "of", "on", "that", "the", "this", "to", "was", "with"],
    "es": ["a", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "un", "una", "y"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pas", "pour", "que", "qui", "sur", "un", "une"],
}
# Character classes beside symbols and white space.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "punctuation": r"[!\"'(),\-./:;=?@\[\\\]^_`{}~+]"}

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_hist_chars: int = 200
    """Documents with fewer characters are not judged by characters."""
    min_hist_words: int = 50
    """Documents with fewer words are not judged by words."""
    max_char_distance: float = 0.30
    max_word_distance: float = 0.65
    max_bare_share: float | None = None
    """If set, also rejects a word distance over this share of the distance that a text without a single common word of its language has."""
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice; linearithmic in the text's words.

    Windows are compared by a 64-bit hash. Many texts end at the first test (as many distinct windows as windows). Else
    windows are sorted with their places, those equal to a neighbour are kept, and the places' union is measured.
    ``words`` must be a bound variable (``let``), as it is named once a window.
    """

    def covered(spots):
        """spots: sorted starts of repeated windows; each covers three words."""
        return F.aggregate(
            F.transform(spots, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(spots, i + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def repeated(placed):
        return F.sort_array(
            F.transform(
                F.filter(placed, lambda x, i: (F.get(placed, i - 1)["w"] == x["w"]) | (F.get(placed, i + 1)["w"] == x["w"])),
                lambda x: x["i"],
            )
        )

    def count(windows):
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(placed, lambda s: let(repeated(s), covered))
        )

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, let(windows, count)).otherwise(F.lit(0).cast("long"))


def _binned(found: Column, listed: list[str], n_words: Column) -> Column:
    each = F.transform(F.array(*map(F.lit, listed)), lambda w: (F.size(found) - F.size(F.call_function("array_remove", found, w))).cast("long"))
    return F.concat(each, F.array((n_words - F.size(found)).cast("long")))


def word_histogram(words: Column, lang: Column, rules: Rules) -> Column:
    """Counts of the language's common words (as listed, in lower case), and of all other words last; null for a language without a list."""
    out = None
    for code, listed in sorted(rules.common_words.items()):
        bins = let(F.filter(words, lambda w: w.isin(listed)), lambda f: _binned(f, listed, F.size(words)))  # noqa: B023  called at once
        out = F.when(lang == code, bins) if out is None else out.when(lang == code, bins)
    return F.lit(None).cast("array<bigint>") if out is None else out


def metrics(text: Column, lang: Column, rules: Rules) -> Column:
    """All that is counted in one pass over a text, as a struct."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), word_histogram(w, lang, rules).alias("words"), repeat_words(w).alias("n_repeat_words"))

    symbols = F.regexp_count(text, F.lit(SYMBOL)).cast("long")
    rest = [F.regexp_count(text, F.lit(p)).cast("long").alias(k) for k, p in CLASSES.items()]
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines")
    return F.struct(let(words, of).alias("w"), symbols.alias("n_symbols"), F.length(text).cast("long").alias("n_chars"), *rest, dup)


def char_histogram(m: Column) -> Column:
    """Bins: the classes, symbols, white space, and all else (lower case and other scripts)."""
    known = [*(m[k] for k in CLASSES), m["n_symbols"], m["n_chars"] - m["w"]["word_chars"]]
    rest = m["n_chars"]
    for k in known:
        rest = rest - k
    return F.array(*known, rest)


def js_distance(p: Column, q: Column) -> Column:
    """Of two arrays of counts. An empty histogram is at distance 0 from all: nothing is known of it."""

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    def from_totals(t):
        terms = F.zip_with(p, q, lambda a, b: let(F.struct((a / t["p"]).alias("a"), (b / t["q"]).alias("b")), lambda s: part(s["a"], s["b"]) + part(s["b"], s["a"])))
        return F.when((t["p"] > 0) & (t["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), 0.5 * total(terms)))).otherwise(F.lit(0.0))

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), from_totals)


def bare_distance(ref_words: Column) -> Column:
    """Distance of a text without common words; null for a language without a list."""
    return F.when(F.size(ref_words) > 1, js_distance(F.concat(F.array_repeat(F.lit(0).cast("long"), F.size(ref_words) - 1), F.array(F.lit(1).cast("long"))), ref_words))


def _base_failed(w: Column, rules: Rules) -> Column:
    return (w["n_words"] < rules.min_words) | (100 * w["n_repeat_words"] > rules.max_repeat_percent * w["n_words"])


def _references(measured: DataFrame, rules: Rules) -> DataFrame:
    """One row a language with the sums over all its documents that pass the base rules."""
    n_chars, n_words = len(CLASSES) + 3, max([0, *map(len, rules.common_words.values())]) + 1
    sums = measured.filter(~_base_failed(F.col("_q_m.w"), rules)).groupBy(F.col("_q_lang").alias("ref_lang")).agg(
        *[F.sum(F.get("_q_c", F.lit(i))).alias(f"c{i}") for i in range(n_chars)], *[F.sum(F.get("_q_h", F.lit(i))).alias(f"w{i}") for i in range(n_words)]
    )
    arrays = F.array(*[f"c{i}" for i in range(n_chars)]).alias("ref_chars"), F.array_compact(F.array(*[f"w{i}" for i in range(n_words)])).alias("ref_words")
    return sums.select("ref_lang", *arrays)


def references(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row a language: ``ref_lang`` (``=`` and its name; empty for null), ``ref_chars``, ``ref_words``."""
    return _references(_measured(docs, [], text, lang, rules), rules)


def _measured(docs: DataFrame, columns: list[Column], text: str, lang: str, rules: Rules) -> DataFrame:
    """``columns`` and what is counted, each under a name of this module's own (``_q_``)."""
    t, code = F.coalesce(F.col(text), F.lit("")), F.col(lang).cast("string")
    m = docs.select(*columns, F.coalesce(F.concat(F.lit("="), code), F.lit("")).alias("_q_lang"), metrics(t, code, rules).alias("_q_m"))
    return m.select(*[c for c in m.columns if c != "_q_m"], "_q_m", char_histogram(F.col("_q_m")).alias("_q_c"), F.col("_q_m.w.words").alias("_q_h"))


def _verdicts(measured: DataFrame, ref: DataFrame, rules: Rules) -> DataFrame:
    if rules.max_bare_share is not None:
        ref = ref.withColumn("_q_bare", bare_distance(F.col("ref_words")))
    ref = F.broadcast(ref) if small(ref, 10_000) else ref
    m, w = F.col("_q_m"), F.col("_q_m.w")
    joined = (
        measured.join(ref, F.col("_q_lang") == F.col("ref_lang"), "left")
        .withColumn("_q_char_distance", F.coalesce(js_distance(F.col("_q_c"), F.col("ref_chars")), F.lit(0.0)))
        .withColumn("_q_word_distance", F.coalesce(js_distance(F.col("_q_h"), F.col("ref_words")), F.lit(0.0)))
    )
    far_words = F.col("_q_word_distance") > rules.max_word_distance
    if rules.max_bare_share is not None:  # a language without any common word in all its texts has nothing to miss
        far_words = far_words | F.coalesce((F.col("_q_bare") > 0) & (F.col("_q_word_distance") > rules.max_bare_share * F.col("_q_bare")), F.lit(False))
    far = ((m["n_chars"] >= rules.min_hist_chars) & (F.col("_q_char_distance") > rules.max_char_distance)) | (
        (w["n_words"] >= rules.min_hist_words) & far_words
    )
    return joined.withColumn("_q_failed", _base_failed(w, rules)).withColumn("_q_kept", ~F.col("_q_failed") & ~far)


def _judged(docs: DataFrame, columns: list[Column], text: str, lang: str, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(measured rows, rows with verdicts). Texts are split and counted once: references need all counts before the first verdict, so ``columns`` are held with their counts beside them."""
    measured = _measured(docs, columns, text, lang, rules).persist(StorageLevel.DISK_ONLY)
    with settings(docs.sparkSession, {"spark.sql.inMemoryColumnarStorage.compressed": "false"}):
        ref = materialise(_references(measured, rules), "quality-reference")
    return measured, _verdicts(measured, ref, rules)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """Per document: the base metrics, both distances, ``base_failed`` and ``kept``. Some forty integers a document are held until the result goes."""
    measured, judged = _judged(docs, [F.col(doc_id).alias("_q_id")], text, lang, rules)
    out = judged.select(
        F.col("_q_id").alias("doc_id"),
        F.col("_q_m.w.n_words").alias("n_words"),
        F.col("_q_m.w.word_chars").alias("word_chars"),
        F.col("_q_m.n_symbols").alias("n_symbols"),
        F.col("_q_m.n_dup_lines").alias("n_dup_lines"),
        F.col("_q_m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("_q_failed").alias("base_failed"),
        F.round("_q_char_distance", 6).alias("char_distance"),
        F.round("_q_word_distance", 6).alias("word_distance"),
        F.col("_q_kept").alias("kept"),
    )
    return hold_for(out, measured)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with exactly their own columns.

    A verdict depends on text and language alone: counts are held by a hash of both while verdicts are found, some 500 bytes a document, and what is written is the rejected hashes.
    Rows are joined with these; they are shuffled only where there are more than can be broadcast.
    """
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")), F.lit("\u0001"), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    measured, judged = _judged(docs, [key.alias("_q_key")], text, lang, rules)
    bad = materialise(judged.filter(~F.col("_q_kept")).select("_q_key").distinct(), "rejected")
    measured.unpersist()
    bad = F.broadcast(bad) if small(bad) else bad
    return docs.join(bad, key == F.col("_q_key"), "left_anti")
