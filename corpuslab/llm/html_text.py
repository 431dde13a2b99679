"""HTML extraction by consensus of a host's pages.

1. Each page is scanned once for its blocks and containers. What elements such as menus, headers, footers, sidebars, forms, scripts and styles hold is no content. Classes, ids and
   roles mark containers: one named by noise words alone (``ad``, ``site-footer``) has no content either; one with a noise word among others counts less. Each container is
   scored by its content; the page votes for one: its largest ``article``, else its largest ``main``, if that holds a third of the content (a teaser or a card doesn't), else the deepest
   that holds most of the content.
2. Votes are counted in Spark by host and generalised path (tags with classes, digits as ``#``; a path is known by a digest of 128 bits). Paths with a fifth of a host's votes win.
3. Each page is extracted again from the containers of the first winning path that it has; a page that has none keeps its own choice. Marked containers are
   left out strictly below the winner only, so that an article whose own class holds a noise word stays.

Text: character references are decoded, white space within a block becomes one space, ends are trimmed, blocks are joined by line feeds in page order.

Cases: null html and pages without content give an empty text. Unclosed and wrongly nested elements end with the element around them, but blocks outlast
inline elements; an unclosed comment, script or tag runs to the page's end; from a tag with an unclosed quote on, tags end at the next ``>``. A null URL belongs to the empty host. Repeated rows vote and are extracted
alike. Elements that are only hidden by style or attribute are text like others. Ties of votes go to the path with more characters, then to the lesser digest; ties of containers to the first. An empty table gives an empty result. Extra columns are not read.

Scale: scanning takes time and memory in proportion to the page, however deep or broken. A vote is one small row a page, combined by (host, path) in map tasks, so a host with a third of
all pages costs no more than others. At most five paths a host win; they are broadcast up to a counted bound, else joined by host. Pages are not shuffled then, and never gathered.
"""

from __future__ import annotations

import functools
import hashlib
import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, bounded_batches, materialise, small
from .url_filter import split_url

# Elements of HTML by what they mean here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
NO_CONTENT = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "head", "fieldset", "object", "canvas", "audio", "video", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
SIBLINGS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Words of classes, ids and roles that mark what is no content; the second list also stands in names of articles.
STRONG = set(
    "ad ads adbox adsense advert adverts advertisement advertising breadcrumb breadcrumbs captcha comment comentarios commentaires commentlist comments complementary contentinfo cookie cookies discussion disqus footer gdpr guestbook kommentare livefyre masthead "
    "menu menubar nav navbar navigation outbrain pager pagination promo promoted promotion reactions recommended related replies respond responses share sharing sidebar skip sponsor sponsored taboola toolbar".split()
)
WEAK = set(
    "alert banner consent copyright dfp dialog form header login modal newsletter notice notices notification popup search signup social subscribe subscription widget".split()
)
# Words that say where something stands, and words that name content.
LAYOUT = set(
    "area bar block bottom box button buttons col column container fixed global group holder inner item items left link links list main outer page panel primary rail right row secondary "
    "section site slot sticky thread top unit wrap wrapper zone".split()
)
CONTENT = {"article", "body", "content", "entry", "post", "story", "text"}
NEGATED = {"has", "with", "no", "without", "is", "hide"}
NEGATED_AFTER = {"free", "less", "off", "closed"}
CONTAINERS = {"article", "body", "center", "div", "main", "section", "table", "tbody", "td", "tr"}

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
TAG_REST = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SHARE, WINNERS, MIN_SHARE = 0.6, 5, 0.2
NAMED_SHARE = 1 / 3
"""Of a page's content that an ``article`` or ``main`` holds that is taken for its name."""
PLAIN, HINTED, SOFT, HARD = range(4)
WEIGHT = {PLAIN: 1.0, HINTED: 0.7, SOFT: 0.2}


def word_mark(word: str) -> int:
    """How much a class, an id or a role says that its element is no content."""
    parts = [p.lower() for p in PART.findall(word)]
    marks = [p for p in parts if p in STRONG or p in WEAK]
    if not marks or (len(parts) > 1 and (parts[0] in NEGATED or parts[-1] in NEGATED_AFTER)):
        return PLAIN
    if all(p in STRONG or p in WEAK or p in LAYOUT for p in parts):
        return HARD
    return HINTED if any(p in CONTENT for p in parts) and not any(p in STRONG for p in marks) else SOFT


class Page:
    """Blocks (container, text, characters in links) and containers (path, parent, depth, tag, mark) of one page; container 0 is the page."""

    def __init__(self, html: str | None):
        self.paths: list[bytes] = [b"body"]
        self.parents: list[int] = [-1]
        self.depths: list[int] = [0]
        self.tags: list[str] = ["body"]
        self.marks: list[int] = [PLAIN]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack: list[tuple[str, bool, int]] = []  # tag, dropped, container
        self._places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
        self._outer: list[int] = []  # places of open elements that are not inline
        self._pieces: list[tuple[str, bool]] = []
        self._scan(html or "")

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(p for p, _ in self._pieces).split())
            if text:
                self.blocks.append((self._stack[-1][2] if self._stack else 0, text, sum(len(p) for p, linked in self._pieces if linked)))
            self._pieces.clear()

    def _open(self, tag: str) -> int:
        """Place of the innermost open element of a tag, or -1."""
        places = self._places.get(tag)
        return places[-1] if places else -1

    def _push(self, tag: str, dropped: bool, container: int) -> None:
        self._places.setdefault(tag, []).append(len(self._stack))
        if tag not in INLINE:
            self._outer.append(len(self._stack))
        self._stack.append((tag, dropped, container))

    def _cut(self, place: int) -> None:
        """Ends all elements from a place on; a block ends if one of them is not inline."""
        if self._outer and self._outer[-1] >= place:
            self._flush()
        while len(self._stack) > place:
            if tag := self._stack.pop()[0]:
                self._places[tag].pop()
        while self._outer and self._outer[-1] >= place:
            self._outer.pop()

    def _text(self, text: str) -> None:
        if text and not (self._stack and self._stack[-1][1]):
            self._pieces.append((htmllib.unescape(text), self._open("a") >= 0))

    def _scan(self, html: str) -> None:
        start = at = 0  # of what is not taken yet; of what is not looked at yet
        quotes = True
        while (at := html.find("<", at)) >= 0:
            name = TAG_NAME.match(html, at + 1)
            if not name and html[at + 1 : at + 2] not in ("!", "?", "/"):  # a sign, not a tag
                at += 1
                continue
            self._text(html[start:at])
            if not name:
                mark = "-->" if html.startswith("<!--", at) else ">"
                start = at = _after(html, mark, at + 2)
                continue
            rest = TAG_REST.match(html, name.end()) if quotes else None
            quotes = rest is not None
            start = at = rest.end() if rest else _after(html, ">", name.end())
            if not rest and at == len(html) and not html.endswith(">"):
                break
            tag, attributes = name[2].lower(), html[name.end() : at - 1]
            self._tag(name[1], tag, attributes)
            if not name[1] and tag in RAW and not attributes.endswith("/"):
                close = _raw_end(tag).search(html, at)
                start = at = _after(html, ">", close.start()) if close else len(html)
        self._text(html[start:])
        self._flush()

    def _tag(self, closing: str, tag: str, attributes: str) -> None:
        if closing:
            place = self._open(tag)
            if place >= 0 and tag in INLINE and self._outer and self._outer[-1] > place and not self._stack[-1][1]:
                self._stack[place] = ("", *self._stack[place][1:])  # blocks that began within go on
                self._places[tag].pop()
            elif place >= 0:
                self._cut(place)
            elif tag not in INLINE:
                self._flush()
            return
        if tag not in INLINE:
            self._flush()
        if tag in RAW or tag in VOID:
            if tag == "br":
                self._pieces.append((" ", False))
            return
        self._imply(tag)
        dropped, outer = self._stack[-1][1:] if self._stack else (False, 0)
        if not dropped:
            classes, mark = self._attributes(tag, attributes)
            inside = self._open("article") >= 0 or self._open("main") >= 0
            dropped = mark == HARD or (mark == SOFT and tag in INLINE) or (tag in NO_CONTENT and not (tag == "header" and inside))
            if not dropped and tag != "body" and (tag in CONTAINERS or (mark and tag not in INLINE)):
                self.paths.append(hashlib.blake2b(self.paths[outer] + b">" + (tag + classes).encode("utf-8", "replace"), digest_size=16).digest())
                self.parents.append(outer)
                self.depths.append(self.depths[outer] + 1)
                self.tags.append(tag)
                self.marks.append(mark)
                outer = len(self.paths) - 1
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "object"):
            self._push(tag, dropped, outer)

    def _imply(self, tag: str) -> None:
        """Ends the elements that ``tag`` implies to have ended."""
        if tag in CLOSES_SAME:
            place = max(map(self._open, SIBLINGS.get(tag, {tag})))
            if place > max(map(self._open, CLOSES_SAME[tag])):
                self._cut(place)
        if tag in CLOSES_P and self._outer and self._stack[self._outer[-1]][0] == "p":
            self._cut(self._outer[-1])

    @staticmethod
    def _attributes(tag: str, text: str) -> tuple[str, int]:
        """Generalised classes for the path; the strongest mark."""
        if "=" not in text:
            return "", PLAIN
        classes, words = "", []
        for name, *values in ATTRIBUTE.findall(text):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "class":
                classes = "".join("." + re.sub(r"\d+", "#", c) for c in sorted(value.split()))
            if tag not in ("html", "body", "main") and (tag != "article" or name == "class"):
                words += value.split()
        marks = [word_mark(w) for w in words]
        mark = max(marks, default=PLAIN)
        if mark:
            strong = any(p.lower() in STRONG for w in words for p in PART.findall(w))
            named = tag == "article" or any(m == PLAIN and any(p.lower() in CONTENT for p in PART.findall(w)) for w, m in zip(words, marks, strict=True))
            if named:  # it says that it is content as well
                mark = min(mark, SOFT if strong else HINTED) if tag != "article" else mark if strong else PLAIN
        return classes, mark

    def content(self) -> list[float]:
        """Characters of content in each container and those within it, weighed by all marks around them; blocks that are mostly links don't count."""
        weight = [1.0] * len(self.paths)
        for c in range(1, len(weight)):
            weight[c] = weight[self.parents[c]] * WEIGHT[self.marks[c]]
        own = [0.0] * len(weight)
        for c, text, linked in self.blocks:
            if 2 * linked <= len(text):
                own[c] += len(text) * weight[c]
        for c in range(len(own) - 1, 0, -1):
            own[self.parents[c]] += own[c]
        return own

    def choice(self) -> tuple[bytes, int] | None:
        """The path the page votes for and its characters; None without content."""
        held = self.content()
        if not held[0]:
            return None
        for tag in ("article", "main"):
            named = [c for c in range(len(held)) if self.tags[c] == tag and held[c] >= NAMED_SHARE * held[0]]
            if named:
                best = max(named, key=lambda c: (held[c], -c))
                return self.paths[best], int(held[best])
        best = max((c for c in range(len(held)) if held[c] >= SHARE * held[0]), key=lambda c: (self.depths[c], held[c], -c))
        return self.paths[best], int(held[best])

    def text(self, winners: list[bytes]) -> str:
        held = self.content()
        full = {self.paths[c] for c in range(len(held)) if held[c]}
        chosen = next((w for w in winners if w in full), None)
        if chosen is None:
            own = self.choice()
            if own is None:
                return "\n".join(t for _, t, _ in self.blocks)
            chosen = own[0]
        inside = [False] * len(held)
        for c in range(len(held)):
            inside[c] = self.paths[c] == chosen or (c > 0 and inside[self.parents[c]] and self.marks[c] < SOFT)
        return "\n".join(t for c, t, _ in self.blocks if inside[c])


def _after(html: str, mark: str, at: int) -> int:
    """Place after the next mark, or the page's end."""
    found = html.find(mark, at)
    return len(html) if found < 0 else found + len(mark)


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, pages, chars: the counted votes."""
    narrow = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(split_url(u.as_py())[0], *own) for u, h in zip(batch.column(0), batch.column(1), strict=True) if (own := Page(h.as_py()).choice())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], ["host", "path", "n"])

    cast = narrow.mapInArrow(run, "host string, path binary, n long")
    return cast.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))


def winning_paths(counted: DataFrame, min_share: float = MIN_SHARE, most: int = WINNERS) -> DataFrame:
    """host, winners: its paths with at least ``min_share`` of its votes, the first ``most``, by votes, characters and name."""
    by_host = Window.partitionBy("host")
    ranked = counted.withColumn("share", F.col("pages") / F.sum("pages").over(by_host)).withColumn("place", F.row_number().over(by_host.orderBy(F.desc("pages"), F.desc("chars"), "path")))
    won = ranked.filter((F.col("share") >= min_share) & (F.col("place") <= most))
    return won.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    won = materialise(winning_paths(votes(pages, url, html)), "winning-paths")
    won = F.broadcast(won) if small(won, BROADCAST_ROWS) else won
    host = F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host.alias("h"))
    joined = base.join(won, F.col("h") == F.col("host"), "left").select("page_id", "url", "html", "winners")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Page(h.as_py()).text(w.as_py() or []) for h, w in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)
