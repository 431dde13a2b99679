"""Spelling variants: words that one edit turns into one another, each led to the form that is written far more often.

A word's mask has one bit for each letter, set if the letter occurs an odd number of times. Inserting or deleting a letter flips one bit, replacing one flips two, so of three bands
of the mask at least one is equal in any two words that are one edit apart. An edit is also at one place: with m letters in the longer word, the first or the last m // 2 letters
of both are equal. Letters alone make few bands, so their groups are split by that half. Words meet where a band, a half, and the length (or the length less one) are equal;
masks that differ in more than two bits are passed over, and what is left is verified.

Cases: null texts have no words, a null id reads as ''. Repeated rows count again. Texts and words are read whole, of any length. Ties of a form's number of occurrences go to the
first word in code-point order. An empty table gives no rows; other columns are not read.

Scale: occurrences are combined in map tasks; only words of enough occurrences travel further. Each pair is made once, under its first equal band and half, and not both ways
before it is verified. Keys that many words share are rows of an ordinary equi-join, whose large partitions adaptive execution splits on either side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise

LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH = 7
WIDTH = 20
"""Bits of a band, of which there are three."""
BITS = [WIDTH * (i % 3) + (i // 3 if i < 26 else 9 + i // 3 % 11) for i in range(26 + 64)]
"""The bit of each letter, a to z and then U+00C0 to U+00FF: every third letter is in the same band, and accented letters share its last eleven bits."""


@dataclass(frozen=True)
class Settings:
    min_count: int = 2
    ratio: int = 10
    """Times a word's own occurrences that its form has at least."""
    spoil: int = 31
    """One of so many (document, word) pairs loses a letter, chosen by its hash; 0: none."""


def runs(text: Column) -> Column:
    """Runs of letters long enough to be words, with only A-Z lower-cased. A longer run is one match, as matches are as long as they can be."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"[{LETTERS.replace('A-Z', '')}]{{{MIN_LENGTH},}}"), F.lit(0))


def spoiled(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run without the letter h % length where the crc32 h of ``<doc_id>:<run>`` is divided by ``one_in``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, n."""
    each = docs.select(F.col("doc_id"), F.explode(runs(F.col("text").cast("string"))).alias("run"))
    word = spoiled(F.col("doc_id"), F.col("run"), s.spoil) if s.spoil else F.col("run")
    n = each.groupBy(word.alias("word")).agg(F.count("*").alias("n"))
    return n.filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= s.min_count))


def mask(word: Column) -> Column:
    """A bit for each letter that the word has an odd number of times (letters of one bit count together)."""
    bits = F.array(*[F.lit(1 << b).cast("long") for b in BITS])
    at = lambda c: F.ascii(c) - F.when(F.ascii(c) < 0x80, 0x61).otherwise(0xC0 - 26)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.get(bits, at(c))))


def band(masks: Column, k: int) -> Column:
    return F.shiftright(masks, WIDTH * k).bitwiseAND((1 << WIDTH) - 1)


def _half(word: Column, e: int, size: Column) -> Column:
    return F.substring(word, F.lit(1), size) if e == 0 else F.substring(word, -size, size)


PLACES = [(k, e) for k in range(3) for e in range(2)]


def near(words: DataFrame) -> DataFrame:
    """a, b: every two words that differ by one edit, each pair once. words: word, mask."""
    word, own = F.col("word"), F.col("mask")

    def key(place: int, longer: Column) -> Column:
        """The place stands in the low bits."""
        k, e = PLACES[place]
        h = F.xxhash64(band(own, k), _half(word, e, F.floor(longer / 2).cast("int")), longer)
        return F.shiftleft(h, 3).bitwiseOR(place)

    keyed = lambda *plus: words.select("word", "mask", F.explode(F.array(*[key(p, F.length(word) + x) for p in range(6) for x in plus])).alias("key"))
    left, right = keyed(0).alias("x"), keyed(0, 1).alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    longer, shorter = F.length(x("word")), F.length(y("word"))
    half = F.floor(longer / 2).cast("int")
    met = [(band(x("mask"), k) == band(y("mask"), k)) & (_half(x("word"), e, half) == _half(y("word"), e, half)) for k, e in PLACES]
    first = F.coalesce(*[F.when(c, F.lit(p)) for p, c in enumerate(met)])
    # of equal length: each pair once; else x is the longer one
    once = ((longer == shorter) & (x("word") < y("word"))) | (longer == shorter + 1)
    pairs = left.join(right, (x("key") == y("key")) & (F.bit_count(x("mask").bitwiseXOR(y("mask"))) <= 2) & once & (first == x("key").bitwiseAND(7)))
    return pairs.select(x("word").alias("a"), y("word").alias("b")).filter(F.levenshtein("a", "b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each word that has a form. forms: word, form.

    Each round doubles the way that is known; forms are ``ratio`` times as frequent as their words, so a way has some 19 steps at most.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        nxt = materialise(now.join(beyond, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        now = nxt.select("word", "root")
        if nxt.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word; form is null where no near word is frequent enough."""
    words = materialise(vocabulary(docs, s).withColumn("mask", mask(F.col("word"))), "words")
    pair = materialise(near(words), "near")
    both = pair.unionAll(pair.select("b", "a")).toDF("word", "other").join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other")))
    around = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.m") >= s.ratio * F.col("n")
    out = words.join(around, "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n")
    )
    out = materialise(out, "variants")
    return out.join(roots(out.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
