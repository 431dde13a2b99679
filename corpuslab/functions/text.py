"""Text expressions: cleaning, collocations, tokens, rates. All are built-in column expressions.

Missing text counts as empty. Patterns follow Unicode classes (``(?U)``) where the semantics need them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L

WORD = "[a-zà-ÿ]{3,}"
LETTER = "[" + "".join(map(chr, [*range(0x61, 0x7B), *range(0xE0, 0x100)])) + "]"
"""``[a-zà-ÿ]`` letter by letter: Java looks such a class up in one table, where it tries ranges one after another."""


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, not once for each place that names it."""
    return F.transform(F.array(value), body)[0]


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean_for_analysis(text: Column) -> Column:
    """Blanks, tags, drop capitals (``L uego``) and two kinds of class names left by editors."""
    t = F.replace(F.replace(filled(text), F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    t = F.regexp_replace(t, "<[^>]{0,300}>", " ")
    t = F.regexp_replace(t, r"(?U)(?<!\w)([A-ZÁÉÍÓÚÑÜ])\s+([a-záéíóúñ]{2,})", "$1$2")
    t = F.regexp_replace(t, r"(?U)\balign(?:center|left|right|none)?\b", " ")
    return F.regexp_replace(t, r"(?U)\bwp-[a-z0-9_-]+", " ")


def repair_mojibake(text: Column) -> Column:
    """UTF-8 read as Latin-1, undone where the whole text can be; else the text as it is."""
    t = filled(text)
    undone = F.try_validate_utf8(F.encode(F.when(~t.rlike(r"[^\x00-\xff]"), t), "ISO-8859-1").cast("string"))
    return F.coalesce(undone, t)


def clean_for_curation(text: Column) -> Column:
    """Mojibake, then a leading byline block or else a section header, footers, and runs of blank lines."""
    t = repair_mojibake(text)
    lead = F.regexp_replace(t, L.BYLINE, "")
    t = F.when(t.rlike(L.BYLINE), lead).otherwise(F.regexp_replace(t, "(?U)" + L.SECTION_HEADER, ""))
    for p in L.FOOTERS:
        t = F.regexp_replace(t, "(?i)" + p, "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_boilerplate(text: Column, phrases: list[str] | None = None) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), L.BOILERPLATE if phrases is None else phrases, filled(text))


def normalise_whitespace(text: Column) -> Column:
    """Tabs and hard blanks to blanks, runs to one, at most one empty line, each line stripped."""
    t = F.regexp_replace(F.translate(filled(text), "\t\u00a0", "  "), " {2,}", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"))


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(filled(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def join_collocations(text: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """Lower-cases and replaces each phrase by its token, in order, also within words."""
    return reduce(lambda t, p: F.regexp_replace(t, "(?U)" + p[0], p[1]), L.COLLOCATIONS if pairs is None else pairs, F.lower(filled(text)))


def without_handles(text: Column) -> Column:
    """Texts that have no part of a link, handle or tag are left as they are, without a look for patterns."""
    whole = filled(text)
    t = F.regexp_replace(whole, r"(?U)https?://\S+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)@\w+", " "), r"(?U)#\w+", " ")
    return F.when(F.contains(whole, F.lit("://")) | F.contains(whole, F.lit("@")) | F.contains(whole, F.lit("#")), t).otherwise(whole)


def without(tokens: Column, *lists: list[str]) -> Column:
    """Tokens that none of the lists has; repetitions stay."""
    stop = sorted({w for words in lists for w in words})
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def tokens(text: Column, stop: list[str] = (), foreign: list[str] = (), collocations: list[tuple[str, str]] | None = None) -> Column:
    """Words of three letters or more and joined phrases, after links, handles and tags are cut.

    A text without a ``_``, to which no phrase adds one, is not searched for joined words: else each word is read twice.
    """
    joined = join_collocations(without_handles(text), collocations)
    found = F.regexp_extract_all(joined, F.lit(f"{LETTER}++(?:_{LETTER}++)+|{LETTER}{{3,}}+"), F.lit(0))
    if collocations is not None and not collocations:
        found = F.when(F.contains(filled(text), F.lit("_")), found).otherwise(F.regexp_extract_all(joined, F.lit(LETTER + "{3,}+"), F.lit(0)))
    return without(found, stop, foreign)


def plain_tokens(text: Column, stop: list[str] = ()) -> Column:
    """Whole words of three letters or more; no phrases."""
    found = F.regexp_extract_all(F.lower(without_handles(text)), F.lit(r"(?U)\b[a-záéíóúüñ]{3,}\b"), F.lit(0))
    return without(found, stop)


def title_tokens(title: Column, stop: list[str] | None = None) -> Column:
    parts = F.transform(F.split(F.lower(filled(title)), r"(?U)\s+"), lambda w: F.btrim(w, F.lit(L.TITLE_PUNCTUATION)))
    return F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(L.TITLE_STOP if stop is None else stop))


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(filled(text), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(r"(?U)\S+"))


def has_words(text: Column, least: int) -> Column:
    """At least so many parts between white space; reads no further than these."""
    return filled(text).rlike(rf"(?U)^\s*+(?:\S++\s++){{{least - 1}}}\S") if least > 0 else F.lit(True)


def bigrams(found: Column) -> Column:
    """Pairs of neighbours, joined by a blank; none for fewer than two tokens."""


    def pairs(t):
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    return let(found, pairs)


def vectorizer_terms(text: Column) -> Column:
    """Words of three letters or more and their bigrams; no stop words."""
    found = F.regexp_extract_all(F.lower(filled(text)), F.lit(WORD), F.lit(0))
    return let(found, lambda t: F.concat(t, bigrams(t)))


def foreign_share(text: Column, foreign: list[str]) -> Column:
    """Share of listed words among runs of three or more of a-z (accents split words); null without any."""
    found = F.regexp_extract_all(F.lower(filled(text)), F.lit("[a-z]{3,}"), F.lit(0))
    return F.try_divide(F.size(F.filter(found, lambda w: w.isin(foreign))).cast("double"), F.size(found).cast("double"))


def mostly_foreign(text: Column, foreign: list[str], share: float = 0.4, least: int = 15) -> Column:
    n = F.size(F.regexp_extract_all(F.lower(filled(text)), F.lit("[a-z]{3,}"), F.lit(0)))
    return (n >= least) & F.coalesce(foreign_share(text, foreign) > share, F.lit(False))


def hits(text: Column, terms: list[str]) -> Column:
    """Whether any term is a substring of the lower-cased text."""
    low = F.lower(filled(text))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms], F.lit(False))


def count_of(text: Column, term: str) -> Column:
    """Occurrences that do not overlap."""
    return F.regexp_count(F.lower(filled(text)), F.lit(re.escape(term)))


def _rate(n: Column, of: Column) -> Column:
    return 100.0 * n / F.greatest(of, F.lit(1))


def exclamation_rate(text: Column) -> Column:
    t = filled(text)
    return _rate(F.length(t) - F.length(F.translate(t, "!?", "")), F.length(t))


def capitals_rate(text: Column) -> Column:
    loud = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)
    return let(words(text), lambda found: _rate(F.size(F.filter(found, loud)), F.size(found)))


def pattern_rate(text: Column, pattern: str) -> Column:
    return _rate(F.regexp_count(filled(text), F.lit(pattern)), F.size(words(text)))


def fingerprint(text: Column, most: int = 2000) -> Column:
    return F.sha2(F.substring(F.regexp_replace(strip(F.lower(filled(text))), r"(?U)\s+", " "), 1, most), 256)


def title_key(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(filled(title)), "[^a-záéíóúñü0-9]", ""), 1, 120)


def found_phrases(lowered: Column, phrases: list[str]) -> Column:
    """Distinct ``phrases`` (words with one space between) that the text has as whole words.

    The text is cut into words once; runs of words that begin with some phrase's first word are looked up in a hash set, for each length that phrases have.
    """
    kept = sorted({p.lower() for p in phrases})
    if odd := [p for p in kept if not re.fullmatch(r"\w+(?: \w+)*", p)]:
        raise ValueError(f"not words with single spaces between: {odd}")
    # what is not one space between two words is a word of its own, which no phrase has
    words = F.split(F.regexp_replace(lowered, r"(?U)[^\w ]+| {2,}", " \u0001 "), " +")

    def of_length(ws: Column, k: int) -> Column:
        own = [p for p in kept if p.count(" ") == k - 1]
        if k == 1:
            return F.filter(ws, lambda w: w.isin(own))
        starts = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(sorted({p.split(" ")[0] for p in own})), i + 1)), lambda i: i.isNotNull())
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(ws, i, k), " ")), lambda p: p.isin(own))

    lengths = sorted({p.count(" ") + 1 for p in kept})
    return let(words, lambda ws: F.array_distinct(F.concat(*[of_length(ws, k) for k in lengths]))) if lengths else F.array().cast("array<string>")


def relevance(title: Column, text: Column, strong: list[str] | None = None, normal: list[str] | None = None, most: int = 1500) -> Column:
    """Two points for each strong and one for each normal keyword found as a whole word; each once."""
    sample = F.lower(F.concat_ws(" ", filled(title), F.substring(filled(text), 1, most)))
    strong, normal = ([k.lower() for k in (own if given is None else given)] for given, own in ((strong, L.STRONG_KEYWORDS), (normal, L.NORMAL_KEYWORDS)))
    points = lambda found: F.size(F.filter(found, lambda p: p.isin(strong))) * 2 + F.size(F.filter(found, lambda p: p.isin(normal)))
    return let(found_phrases(sample, strong + normal), points)


def whole(keyword: str) -> str:
    return r"(?U)\b" + re.escape(keyword.lower()) + r"\b"


def any_whole(keywords: list[str]) -> str:
    return r"(?U)\b(?:" + "|".join(re.escape(k.lower()) for k in keywords) + r")\b"


def irrelevant_title(title: Column, irrelevant: list[str] | None = None, strong: list[str] | None = None) -> Column:
    t = F.lower(filled(title))
    return t.rlike(any_whole(L.IRRELEVANT_KEYWORDS if irrelevant is None else irrelevant)) & ~t.rlike(any_whole(L.STRONG_KEYWORDS if strong is None else strong))


def about(text: Column, place: str = L.ABOUT_PLACE, person: str = L.ABOUT_PERSON, terms: str = L.ABOUT_TERMS) -> Column:
    """Three mentions of the place, or two of the person, or two and one key term, or one and three."""
    p, n, k = count_of(text, place), count_of(text, person), F.regexp_count(filled(text), F.lit(terms))
    return (p >= 3) | (n >= 2) | ((p >= 2) & (k >= 1)) | ((p >= 1) & (k >= 3))


def error_page(title: Column, text: Column, most: int = 300, pattern: str = L.ERROR_PAGE) -> Column:
    return F.lower(F.concat_ws(" ", filled(title), F.substring(filled(text), 1, most))).rlike("(?i)" + pattern)


def parse_count(value: Column) -> Column:
    """``1,234``, ``1.2K``, ``3.4M`` or the first run of digits without separators."""
    t = strip(filled(value))
    bare = F.replace(t, F.lit(","), F.lit(""))
    number = F.regexp_extract(bare, r"^([\d.]+)\s*([kKmM])?$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(bare, r"^([\d.]+)\s*([kKmM])?$", 2))
    scaled = F.round(number * F.when(unit == "K", 1000).when(unit == "M", 1_000_000).otherwise(1), 6).try_cast("long")
    first = F.regexp_extract(F.replace(bare, F.lit("."), F.lit("")), r"(\d+)", 1).try_cast("long")
    return F.coalesce(scaled, first)


def safe_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(F.replace(value.cast("string"), F.lit(","), F.lit("")).try_cast("int"), F.lit(default))


def safe_year(value: Column) -> Column:
    y = value.cast("string").try_cast("int")
    return F.when(y.between(1990, 2100), y)


def mentions_entity(entities: Column, name: str) -> Column:
    """``Name (TYPE)|Name (TYPE)`` holds a name, in any case."""
    return F.contains(F.lower(filled(entities)), F.lit(name.lower()))


def safe_name(url: Column, most: int = 150) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(filled(url), "^https?://", ""), "[^A-Za-z0-9._-]+", "_"), 1, most)


def document_url(doc_id: Column, base: str) -> Column:
    text = doc_id.cast("string")
    return F.concat(F.lit(base + "?id="), F.base64(F.encode(text, "UTF-8")), F.lit("&inst="), text)


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(filled(url), "[?#].*$", ""), r"[^/]\.([^./]+)$", 1))
