"""Document fingerprints: a Merkle tree over a text's paragraphs and sections, written out as one string.

* A paragraph is a line with its line end. Its leaf is the SHA-256 of its text; beside it stand the prints (24 bits) of its clauses, pieces of at most 48 characters between marks.
* A section ends after a blank line, or after a paragraph whose hash says so (one in eight): the text decides, so an edit moves few borders. Its node is the SHA-256 of its leaves.
* The root is the SHA-256 of the sections' nodes. As paragraphs keep their line ends, texts are equal exactly if their roots are.

A fingerprint is ``root|section;section;...`` with sections ``node:paragraph,paragraph,...`` and paragraphs ``hash-length.piece.piece...``; nodes and hashes but the root's are cut
to 16 hex digits. ``likeness`` is 1 for equal roots and else the share of clauses that both have (Dice), the root counting as one. ``edited_span`` goes down the differing branches:
past equal sections from either end, then past equal paragraphs, to the characters between.

Cases: null is the empty text, which has a root but no paragraphs; it is like itself (1) and unlike all others. Rows with equal id and text are one document: they have the same next
document and give the same row each. Documents without an id come last. Documents of one id follow each other by the MD5 of their texts. With a single document, the next one is itself.
Texts are read whole, of any length. An empty table gives no rows; other columns are not read.

Scale: built-in expressions only. Documents are put in order by ids, lengths and MD5s alone, in ranges; texts are shuffled once, and of the next document no more than the
characters that are needed travel, with its fingerprint. A fingerprint takes about a fifth of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from .common import let, materialise

CLAUSE = r"[^\s.!?,;:](?:[^.!?,;:]{0,47}(?![^\s.!?,;:])|[^\s.!?,;:]{0,47})"
"""Up to a mark, or to the white space before 48 characters are over; a longer word is cut."""
PARAGRAPH = r"[^\n]*\n|[^\n]+"


def _hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _print(clause: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(clause).bitwiseAND(0xFFFFFF))), 6, "0")


def paragraphs(text: Column) -> Column:
    """array<struct<hash, part, close>>: the leaf, its place in the fingerprint, and whether the section ends after it."""

    def one(p: Column) -> Column:
        clauses = F.concat(F.lit(""), F.array_join(F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), lambda c: F.concat(F.lit("."), _print(c))), ""))
        part = lambda h: F.concat(F.substring(h, 1, 16), F.lit("-"), F.length(p).cast("string"), clauses)
        ends = lambda h: F.substring(h, 1, 1).isin("0", "8") | (F.trim(F.translate(p, "\r\n\t", "   ")) == "")
        return let(_hex(p), lambda h: F.struct(h.alias("hash"), part(h).alias("part"), ends(h).alias("close")))

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), one)


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string."""

    def tree(ps: Column) -> Column:
        # sections are cut where a paragraph closes one; a leaf's hash and its part travel side by side
        rows = F.transform(ps, lambda p: F.concat(p["hash"], F.lit("~"), p["part"], F.when(p["close"], F.lit(";")).otherwise(F.lit(","))))
        sections = F.filter(F.split(F.array_join(rows, ""), ";"), lambda x: x != "")
        named = F.transform(sections, lambda x: let(F.regexp_replace(x, ",$", ""), _section))
        whole = lambda ns: F.concat(_hex(F.array_join(F.transform(ns, lambda n: n["node"]), "")), F.lit("|"), F.array_join(F.transform(ns, lambda n: n["text"]), ";"))
        return let(named, whole)

    return let(paragraphs(text), tree)


def _section(rows: Column) -> Column:
    node = _hex(F.array_join(F.regexp_extract_all(rows, F.lit("([0-9a-f]{64})~"), F.lit(1)), ""))
    body = F.regexp_replace(rows, "[0-9a-f]{64}~", "")
    return let(node, lambda n: F.struct(n.alias("node"), F.concat(F.substring(n, 1, 16), F.lit(":"), body).alias("text")))


def root(fp: Column) -> Column:
    return F.substring_index(fp, "|", 1)


def _clauses(fp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"\.([0-9a-f]{6})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 only for equal texts."""
    dice = let(F.struct(_clauses(a).alias("a"), _clauses(b).alias("b")), lambda s: 2.0 * F.size(F.array_intersect(s["a"], s["b"])) / (F.size(s["a"]) + F.size(s["b"]) + 2))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(dice)


def _sections(fp: Column) -> Column:
    return F.filter(F.split(F.substring_index(fp, "|", -1), ";"), lambda x: x != "")


def _parts(sections: Column) -> Column:
    """Paragraphs of some sections, as array<struct<hash, n>>."""
    return F.transform(
        F.filter(F.split(F.array_join(F.transform(sections, lambda s: F.substring_index(s, ":", -1)), ","), ","), lambda x: x != ""),
        lambda p: let(F.substring_index(p, ".", 1), lambda h: F.struct(F.substring_index(h, "-", 1).alias("hash"), F.substring_index(h, "-", -1).cast("long").alias("n"))),
    )


def _common(a: Column, b: Column) -> Column:
    """Equal members that both arrays begin with."""
    least = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x == y), False)
    return F.when(differ == 0, least).otherwise((differ - 1).cast("int"))


def _chars(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total + p["n"])


def edited_span(a: Column, b: Column) -> Column:
    """struct<first, last, sections, paragraphs>: characters first (from 0) to last (exclusive) of a's text are those that b's tree has not in this place, with the number of
    a's sections and paragraphs there. Null where the roots are equal."""

    def middle(x: Column, y: Column, then) -> Column:
        """``then(head, x', y', tail)``: what both begin and end with, and what is between."""
        rest = lambda z, h: F.slice(z, h + 1, F.greatest(F.size(z) - h, F.lit(0)))
        return let(_common(x, y), lambda h: let(F.struct(rest(x, h).alias("x"), rest(y, h).alias("y")), lambda r: let(_common(F.reverse(r["x"]), F.reverse(r["y"])), lambda t: then(F.slice(x, 1, h), *(F.slice(r[k], 1, F.size(r[k]) - t) for k in "xy")))))

    def down(head: Column, x: Column, y: Column) -> Column:
        before = let(_parts(head), _chars)
        inside = lambda h, p, _: let(before + _chars(h), lambda at: F.struct(at.alias("first"), (at + _chars(p)).alias("last"), F.size(x).alias("sections"), F.size(p).alias("paragraphs")))
        return let(F.struct(_parts(x).alias("x"), _parts(y).alias("y")), lambda s: middle(s["x"], s["y"], inside))

    span = let(F.struct(_sections(a).alias("a"), _sections(b).alias("b")), lambda s: middle(s["a"], s["b"], down))
    return F.when(root(a) != root(b), span)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.length(t).cast("long").alias("n_chars"), fingerprint(t).alias("fingerprint"))


def _in_order(own: DataFrame, rows: int) -> DataFrame:
    """key, and of the document before: pre, pre_id, take (characters that it takes from this one). Documents by falling id. own: _id, _text, _key."""
    narrow = own.select("_id", "_key", F.floor(F.length("_text") / 3).cast("long").alias("take")).distinct()
    n = max(own.sparkSession.sparkContext.defaultParallelism, 1 + rows // ranges.ROWS_A_RANGE)
    p = ranges.placed(narrow, [F.col("_id").desc_nulls_last(), F.col("_key")], n)
    before = p.rows.select(F.col("_key").alias("pre"), F.col("_id").alias("pre_id"), "take", F.pmod(F.col("_place") + 1, F.lit(max(p.total, 1))).alias("_place"))
    return materialise(p.rows.select(F.col("_key").alias("key"), "_place").join(before, "_place").drop("_place"), "document-order")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, next_fingerprint: each document, and what it becomes when its last third gives way to the start of the next one."""
    t, i = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(doc_id)
    key = F.concat(F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")), F.lit(" "), F.md5(t))  # never null, so that both joins and the sum by it share one shuffle
    own = docs.select(i.alias("_id"), t.alias("_text"), key.alias("_key"))
    order = _in_order(own, docs.count())
    texts = own.select("_text", "_key")  # the same columns for both joins, so that one shuffle serves both
    prefix = F.substring(F.col("_text"), F.lit(1), F.col("take").cast("int")).alias("prefix")
    nxt = texts.join(order, F.col("_key") == F.col("key")).select("pre", "pre_id", prefix, fingerprint(F.col("_text")).alias("next_fingerprint"))
    nxt = nxt.groupBy("pre").agg(*[F.first(c).alias(c) for c in ("pre_id", "prefix", "next_fingerprint")])  # a row may be there many times
    both = texts.join(nxt, F.col("_key") == F.col("pre"))
    kept = F.length("_text") - F.floor(F.length("_text") / 3)
    whole = both.select(F.col("pre_id").alias("doc_id"), F.col("_text").alias("text"), F.concat(F.substring(F.col("_text"), F.lit(1), kept.cast("int")), "prefix").alias("edited"), "next_fingerprint")
    return whole.select("doc_id", "text", "edited", fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
