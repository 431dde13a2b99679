"""HTML: titles, dates, links and counts by patterns; text and article content by a parser in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as L
from .text import filled, let, parse_count, strip

# What holds no text; classes and ids of navigation; where articles are.
NO_TEXT = {"script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "form", "svg"}
NAVIGATION = re.compile(r"(sidebar|widget|menu|nav|breadcrumb|social|share|comment-|related|footer|cookie|banner|popup|modal|advertis|ad-|newsletter|subscribe|paywall)", re.I)
SELECTORS = ["article .entry-content", "article .post-content", ".article-body", ".story-body", ".nota-contenido", ".article-content", ".post-body", ".field-item", "article", ".entry-content", ".post-content", "main .content", "#content"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DATE_NAMES = ["article:published_time", "datePublished", "date", "pubdate", "publish_date", "DC.date.issued", "article:modified_time", "dateModified"]
DATE_KEYS = ["datePublished", "dateCreated", "dateModified"]


def _tagless(text: Column) -> Column:
    return strip(F.regexp_replace(text, "<[^>]+>", ""))


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by property or name, attributes in either order; null if there is none."""
    n = re.escape(name)
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]*\b(?:property|name)\s*=\s*["']{n}["'][^>]*\bcontent\s*=\s*["']([^"']*)""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\b(?:property|name)\s*=\s*["']{n}["']""", 1)
    return F.nullif(strip(F.coalesce(F.nullif(a, F.lit("")), b)), F.lit(""))


def title(html: Column) -> Column:
    """og:title, else the first h1, else the title."""
    h = filled(html)
    inner = lambda tag: F.nullif(_tagless(F.regexp_extract(h, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))
    return F.coalesce(meta(h, "og:title"), inner("h1"), inner("title"))


def json_ld(html: Column) -> Column:
    """array<variant>: the objects of a page's JSON-LD scripts, in order: each script's own, those of its list, and those of an ``@graph`` in either. Broken scripts have none."""
    bodies = F.regexp_extract_all(filled(html), F.lit(r"""(?is)<script[^>]*\bapplication/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    listed = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    top = F.flatten(F.transform(bodies, lambda b: let(F.try_parse_json(b), lambda v: F.concat(F.array(v), listed(v, "$")))))
    return F.flatten(F.transform(top, lambda v: F.concat(F.array(v), listed(v, "$['@graph']"))))


def json_value(html: Column, *keys: str) -> Column:
    """The first non-empty text under the first of ``keys`` that any object of the page's JSON-LD has."""
    text = lambda k, v: F.nullif(strip(F.try_variant_get(v, f"$['{k}']", "string")), F.lit(""))
    return let(json_ld(html), lambda nodes: F.coalesce(*[F.get(F.array_compact(F.transform(nodes, partial(text, k))), 0) for k in keys]))


def date_text(html: Column) -> Column:
    """Meta names in turn, JSON-LD keys, a time element, then visible dates among the first 1000 characters of text."""
    h = filled(html)
    top = F.substring(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>", ""), "<[^>]+>", ""), 1, 1000)
    seen = [F.nullif(F.regexp_extract(top, p, 0), F.lit("")) for p in (r"(?U)\d{1,2}\s+de\s+\w+\s+de\s+\d{4}", r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}")]
    time = F.nullif(F.regexp_extract(h, r"""(?is)<time[^>]*\bdatetime\s*=\s*["']([^"']*)""", 1), F.lit(""))
    return F.coalesce(*[meta(h, n) for n in DATE_NAMES], json_value(h, *DATE_KEYS), time, *seen)


def links(html: Column, base: Column) -> Column:
    """Distinct absolute links without query or fragment, in order."""
    raw = F.regexp_extract_all(filled(html), F.lit(r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']([^"'#?]+)"""), F.lit(1))
    root = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.concat(F.regexp_replace(base, "[?#].*$", "")), "^(https?://[^/]+(?:/.*)?/)", 1)

    def absolute(x):
        return F.when(x.rlike("^https?://"), x).when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).when(F.startswith(x, F.lit("/")), F.concat(root, x)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), x))

    return F.array_distinct(F.transform(F.filter(raw, lambda x: ~x.rlike("(?i)^(mailto|javascript|tel):")), absolute))


def selected(html: Column, selector: str) -> Column:
    """Text up to the next tag of the first element with a digit there that a selector names; empty if there is none."""
    inside = r"[^>]*>([^<]*\d[^<]*)"
    classed = lambda tag, name: rf"""<{tag}\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?{re.escape(name)}(?:\s[^"']*)?["']"""
    if m := re.fullmatch(r'meta\[property="(\w+)"\]', selector):
        return F.coalesce(meta(html, m[1]), F.lit(""))
    if m := re.fullmatch(r'(\w+)\[([\w-]+)="(\w+)"\]', selector):
        pattern = rf"""<{m[1]}\b[^>]*\b{m[2]}\s*=\s*["']{m[3]}["']""" + inside
    elif m := re.fullmatch(r"(\w+)\.([\w-]+) (\w+)", selector):
        pattern = classed(m[1], m[2]) + rf"[^>]*>(?:(?!</{m[1]}\b).)*?<{m[3]}\b" + inside
    else:
        tag, name = selector.split(".")
        pattern = classed(tag or r"\w+", name) + inside
    return F.regexp_extract(html, "(?is)" + pattern, 1)


def engagement(html: Column) -> Column:
    """struct of comment, like, share and view counts: JSON-LD, meta, classes, data attributes; null if not found."""
    h = filled(html)
    found = lambda c: F.nullif(c, F.lit(""))

    def statistic(nodes, kind):
        """The count of the first interaction of this kind; types are texts or objects, statistics lists or one object."""
        every = F.flatten(F.transform(nodes, lambda v: F.coalesce(F.try_variant_get(v, "$.interactionStatistic", "array<variant>"), F.array_compact(F.array(F.try_variant_get(v, "$.interactionStatistic", "variant"))))))
        own = F.filter(every, lambda s: F.contains(F.to_json(F.try_variant_get(s, "$.interactionType", "variant")), F.lit(kind)))
        return found(F.get(F.array_compact(F.transform(own, lambda s: F.try_variant_get(s, "$.userInteractionCount", "string"))), 0))

    def listed(kind):
        return [found(selected(h, s)) for s in L.COUNT_SELECTORS[kind]]

    def data(name):
        return found(F.regexp_extract(h, rf"""(?is)<\w+[^>]*\bdata-{name}\s*=\s*["']([^"']*\d[^"']*)""", 1))

    def counted(nodes):
        own = found(F.get(F.array_compact(F.transform(nodes, lambda v: F.try_variant_get(v, "$.commentCount", "string"))), 0))
        comment = F.coalesce(statistic(nodes, "Comment"), own, meta(h, "commentCount"), *listed("comments"), data("comments"))
        like = F.coalesce(statistic(nodes, "Like"), *listed("likes"))
        share = F.coalesce(statistic(nodes, "Share"), *listed("shares"), data("shares"))
        # the first text with a digit counts, and is read once
        return F.struct(*[let(c, parse_count).alias(f"{n}_count") for n, c in (("comment", comment), ("like", like), ("share", share), ("view", F.coalesce(*listed("views"))))])

    return let(json_ld(h), counted)


class _Text(HTMLParser):
    """Text of a page, and of the first element that each selector (at most two simple parts) names, in one pass."""

    def __init__(self, selectors: list[str] = ()):
        super().__init__(convert_charrefs=True)
        self.wants = [s.split() for s in selectors]
        self.stack: list[tuple[str, bool, frozenset[int]]] = []  # tag, dropped, selectors it is within
        self.open: list[tuple[str, str, str]] = []
        self.parts: list[str] = []
        self.found: list[list[str]] = [[] for _ in self.wants]
        self.done: set[int] = set()

    @staticmethod
    def _is(part: str, tag: str, classes: list[str], own: str) -> bool:
        return part[1:] in classes if part[0] == "." else own == part[1:] if part[0] == "#" else tag == part

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        classes, own = (a.get("class") or "").split(), a.get("id") or ""
        dropped, within = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, frozenset())
        more = [
            i for i, want in enumerate(self.wants)
            if i not in within and i not in self.done and self._is(want[-1], tag, classes, own) and (len(want) == 1 or any(self._is(want[0], *o) for o in self.open))
        ]
        dropped = dropped or tag in NO_TEXT or bool(NAVIGATION.search(own)) or any(NAVIGATION.search(c) for c in classes)
        self.stack.append((tag, dropped, within | {*more} if more else within))
        self.open.append((tag, classes, own))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                before = self.stack[-1][2]
                del self.stack[k:], self.open[k:]
                self.done |= before - (self.stack[-1][2] if self.stack else frozenset())
                return

    def handle_data(self, data):
        dropped, within = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, frozenset())
        if not dropped:
            self.parts.append(data)
            for i in within - self.done:
                self.found[i].append(data)


def _cleaned(parts: list[str]) -> str:
    text = re.sub(r"<[^>]+>", "", "\n".join(parts))
    for phrase in L.BOILERPLATE:
        text = text.replace(phrase, "")
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", unicodedata.normalize("NFC", text))
    text = re.sub(r"[ ]{2,}", " ", text.replace("\t", " ").replace("\u00a0", " "))
    return "\n".join(x.strip() for x in re.sub(r"\n{3,}", "\n\n", text).split("\n")).strip()


def _parsed(html: str | None, selectors: list[str] = ()) -> _Text:
    p = _Text(selectors)
    p.feed(html or "")
    p.close()
    return p


def page_text(html: str | None) -> str:
    return _cleaned(_parsed(html).parts)


def _article(p: _Text, page: str, least: int = 100) -> str:
    return next((t for found in p.found if len(t := _cleaned(found)) > least), None) or page


def article_text(html: str | None, selectors: list[str], least: int = 100) -> str:
    p = _parsed(html, selectors)
    return _article(p, _cleaned(p.parts), least)


@F.pandas_udf(T.StringType())
def text_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Clean text of whole pages."""
    for s in pages:
        yield s.map(page_text)


@F.pandas_udf(T.StringType())
def content_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Clean text of the article: the first selector that gives enough, else the page."""
    for s in pages:
        yield s.map(lambda h: article_text(h, SELECTORS))


@F.pandas_udf(T.StructType([T.StructField("content", T.StringType()), T.StructField("page", T.StringType())]))
def texts_of(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Both of them, for which a page is parsed once and goes to one worker."""

    def both(html: str | None) -> tuple[str, str]:
        p = _parsed(html, SELECTORS)
        page = _cleaned(p.parts)
        return _article(p, page), page

    for s in pages:
        yield pd.DataFrame([both(h) for h in s], columns=["content", "page"])


@F.pandas_udf(T.StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
