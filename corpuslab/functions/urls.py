"""URL expressions and rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from .dates import year_of_url
from .text import filled


def netloc(url: Column) -> Column:
    return F.regexp_extract(filled(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(filled(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def domain(name: Column, url: Column) -> Column:
    """The name, or the URL's; without ``www.``, lower case."""
    given = F.trim(filled(name))
    return F.lower(F.regexp_replace(F.when(given == "", netloc(url)).otherwise(given), r"^www\.", ""))


def normalise(url: Column) -> Column:
    """Without fragment, ``utm_`` parameters and slashes at the end."""
    u = F.regexp_replace(filled(url), "#.*$", "")
    return F.regexp_replace(F.regexp_replace(u, r"[?&]utm_\w+=[^&]*", ""), "/+$", "")


def article(url: Column, skip: list[str] | None = None, least: int = 20) -> Column:
    u = filled(url)
    return (F.length(u) >= least) & ~u.rlike("(?i)" + "|".join(f"(?:{p})" for p in (L.SKIP_URL if skip is None else skip)))


def rejected_section(url: Column, sections: list[str] | None = None, at_end: bool = False) -> Column:
    """Has one of the sections as a path segment; with ``at_end`` also as the last."""
    names = "|".join(map(re.escape, L.SKIP_SECTIONS if sections is None else sections))
    return filled(url).rlike(f"(?i)/({names})" + ("(/|$)" if at_end else "/"))


def _slug(url: Column) -> Column:
    clean = F.regexp_replace(filled(url), "[?#].*$", "")
    return F.lower(F.translate(F.regexp_replace(clean, "^https?://[^/]+", ""), "-_/", "   "))


def _any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


def prefilter(url: Column, government: Column | None = None, first: int = 2015, last: int = 2025, irrelevant=None, strong=None, sections=None) -> Column:
    """A year within the range if there is one, and no irrelevant slug without a political one. Government passes."""
    y, s = year_of_url(url), _slug(url)
    bad = _any(s, L.URL_IRRELEVANT if irrelevant is None else irrelevant) & ~_any(s, (L.URL_STRONG if strong is None else strong) + (L.URL_SECTIONS if sections is None else sections))
    ok = F.coalesce(y.between(first, last), F.lit(True)) & ~bad
    return ok if government is None else government | ok


def relevance(url: Column, skip: list[str], keep: list[str]) -> Column:
    """False if a segment is to be skipped, else true if one is to be kept, else null."""
    segments = F.split(F.lower(path(url)), r"[/\-_]")
    of = lambda names: F.arrays_overlap(segments, F.array(*map(F.lit, names)))
    return F.when(filled(url) == "", F.lit(None).cast("boolean")).when(of(skip), F.lit(False)).when(of(keep), F.lit(True))


def homepage_redirect(asked: Column, got: Column) -> Column:
    """A redirect to another host, or to a bare front page."""
    bare = lambda u: F.regexp_replace(F.lower(netloc(u)), r"^www\.", "")
    front = F.regexp_replace(path(got), "/+$", "") == ""
    return (bare(asked) != bare(got)) | (front & (F.regexp_replace(path(asked), "/+$", "") != ""))


def rule_chain(rules: list[tuple[Column, str]], accepted: str = "kept") -> Column:
    """The name of the first rule that rejects."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules], F.lit(accepted))


def geo_reason(url: Column, country: Column, own: list[str], skip: list[str], code: str = "ES") -> Column:
    host = domain(F.lit(""), url)
    return rule_chain([(filled(url) == "", "no_url"), (host.isin(skip), "domain"), (~((filled(country) == code) | host.isin(own)), "geo"), (rejected_section(url), "section")])


def priority_reason(url: Column, priority: list[str], own: list[str], skip: list[str]) -> Column:
    host = domain(F.lit(""), url)
    return rule_chain([(filled(url) == "", "no_url"), (host.isin(own), "domestic"), (host.isin(skip), "domain"), (~host.isin(priority), "not_priority"), (rejected_section(url, at_end=True), "section")])
