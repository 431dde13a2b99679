"""URL filters: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

The longest rule that fits decides (a rule's host fits itself and its subdomains; its path is a prefix). Without one, the URL (A-Z lower-cased) is
scanned once for all terms; a find counts only if no letter or digit (a-z, 0-9) stands next to it. Each different term counts once: a strict one with the weight that
blocks, a soft one with its own (1 by default); together at ``soft_limit`` or more they block the URL. So one strict term blocks, and so do ``soft_limit`` different soft ones.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end.

Cases: null URLs and such without ``://`` have neither host nor path; null is allowed, others are still scanned. Of rules of equal length and equal
text the first counts. Repeated rows each get the same. A long URL is scanned whole, in time proportional to its length and its finds. An empty table gives an empty result. Extra
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default vocabulary, chosen by hand for the usual categories of public blocklists (adult, gambling, drugs, cracked software, fraud and attacks) in English,
# German, Spanish and French; no list was copied. Strict terms name a category by themselves, soft ones are ordinary words that gather on such pages.
STRICT = [
    "camgirls", "casino", "casinos", "cialis", "hentai", "kasino", "kasinos", "keygens", "levitra", "livesex", "malware", "milf", "phishing", "porn", "porno", "pornos", "ransomware", "sexcam",
    "sexcams", "spam", "tragaperras", "viagra", "warez", "xxx",
]
SOFT = [
    "adult", "apuestas", "barato", "bet", "bets", "betting", "billig", "bonus", "cheap", "click", "clicks", "crack", "cracked", "desnudas", "discount", "erotic", "erotico", "erotik", "erotique",
    "escort", "escorts", "farm", "free", "gewinnspiel", "gratis", "gratuit", "jackpot", "keygen", "kostenlos", "kredit", "loan", "loans", "loterie", "lotteria", "lottery", "lotto", "nackt", "nude",
    "nudes", "pastillas", "payday", "pillen", "pills", "pilules", "poker", "prestamos", "replica", "roulette", "sex", "sexe", "sexo", "sexy", "slots", "sorteo", "torrent", "torrents", "wetten", "win",
]
# The contract's rules (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Vocabulary:
    strict: list[str] = field(default_factory=lambda: STRICT)
    soft: list[str] = field(default_factory=lambda: SOFT)
    soft_limit: int = 2
    weights: dict[str, int] = field(default_factory=dict)
    """Of soft terms; others weigh 1. A strict term weighs as much as the limit."""

    def weight(self, strict: set[str], soft: set[str]) -> int:
        return self.soft_limit * len(strict) + sum(self.weights.get(t, 1) for t in soft)


def split_url(url: str | None) -> tuple[str, str]:
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(LOWER), rest[end:stop]


class Judge:
    def __init__(self, rules: list[tuple[str, str, str]], vocabulary: Vocabulary):
        import ahocorasick

        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host.translate(LOWER), []).append((len(host + path), host + path, path, verdict))
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()  # term and class
        for term in {*vocabulary.strict, *vocabulary.soft}:
            low = term.translate(LOWER)
            self.automaton.add_word(low, (low, term in vocabulary.strict))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        labels = host.split(".")
        for k in range(len(labels)):
            for rule in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(rule[2]) and (best is None or rule[0] > best[0]):
                    best = rule
        return best and (best[1], best[3])

    def terms(self, url: str) -> tuple[set[str], set[str]]:
        """Different strict and soft terms found within boundaries."""
        low, found = url.translate(LOWER), (set(), set())
        if len(self.automaton):
            for end, (term, strict) in self.automaton.iter(low):
                start = end - len(term)
                if (start < 0 or low[start] not in WORD) and (end + 1 == len(low) or low[end + 1] not in WORD):
                    found[0 if strict else 1].add(term)
        return found

    def __call__(self, url: str | None) -> tuple:
        host, path = split_url(url)
        strict, soft = self.terms(url or "")
        rule = self.rule(host, path) if host else None
        verdict = rule[1] if rule else "block" if self.vocabulary.weight(strict, soft) >= self.vocabulary.soft_limit else "allow"
        return host, path, rule and rule[0], verdict, sorted(strict), sorted(soft)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list | None = None, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Per page: host, path, rule, verdict, strict and soft (terms found)."""
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    text, many = T.StringType(), T.ArrayType(T.StringType())
    schema = T.StructType([narrow.schema["page_id"], *[T.StructField(c, text) for c in ("host", "path", "rule", "verdict")], *[T.StructField(c, many) for c in ("strict", "soft")]])
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(rules, vocabulary)
        kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
        for batch in batches:
            columns = list(zip(*map(own, batch.column(1).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], schema.names)

    return narrow.mapInArrow(run, schema)
