"""Line dedup: lines that too many pages of their own site have are boilerplate.

For each host, the share of its pages that contain a line is the number of pages with that line by the number of pages; a line whose
share exceeds ``max_share`` and that at least ``min_pages`` pages have is dropped from all of them. Exact copies of a page (same host and text) count
as one page: a page fetched a thousand times is no evidence that its lines are boilerplate.

Lines are compared without blanks at their ends; blank lines are kept and never counted.

Cases: a null host is a host of its own; a null text stays null and counts as a page without lines; a page whose lines all go stays, with its
blank lines only. Repeated rows each get the same result. A share equal to the limit (a tie) keeps the line. Long texts are read whole. An empty table gives an empty result. Extra
columns pass through ``drop_boilerplate``.

Scale: a page's distinct lines become (host, line, page) hashes of 64 bits each, which are counted in two steps (first distinct pages within a map
task and line, then by line), so that a host with a third of all pages, or a line that all have, is combined before it is shuffled. No text is
shuffled. Boilerplate lines are at most (lines a page / max_share) a host, whatever its number of pages; they are broadcast as one
array a host up to a counted bound, else joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, materialise, small

BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _host(host: str) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_share: float = 0.1, min_pages: int = 3) -> DataFrame:
    """h (host's hash), line (hash), pages, host_pages: the lines to drop."""
    pages = docs.select(_host(host).alias("h"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("page"), F.col(text).alias("_t"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_t")), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0), _line_key))
    counted = pages.select("h", "page", F.explode(keys).alias("line")).groupBy("h", "line").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= min_pages)
    totals = pages.groupBy("h").agg(F.countDistinct("page").alias("host_pages"))
    return counted.join(totals, "h").filter(F.col("pages") > max_share * F.col("host_pages"))


def _marked(docs: DataFrame, columns: list[Column], host: str, text: str, max_share: float, min_pages: int) -> DataFrame:
    found = materialise(boilerplate(docs, host, text, max_share, min_pages), "boilerplate")
    by_host = found.groupBy("h").agg(F.collect_set("line").alias("_l_drop"))
    by_host = F.broadcast(by_host) if small(found, BROADCAST_ROWS) else by_host
    placed = docs.select(*columns, _host(host).alias("_l_host"), F.col(text).alias("_l_text")).join(by_host, F.col("_l_host") == F.col("h"), "left")
    whole = F.struct(F.col("_l_text").alias("text"), F.lit(0).alias("dropped"))

    def cleaned(lines):
        def without(bad):
            kept = F.filter(lines, lambda x: (F.length(F.btrim(x, F.lit(BLANKS))) == 0) | ~F.array_contains(bad, _line_key(x)))
            cut = let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), (F.size(lines) - F.size(k)).alias("dropped")))
            return F.when(F.size(bad) == 0, whole).otherwise(cut)

        return let(F.array_intersect(F.transform(lines, _line_key), F.col("_l_drop")), without)  # by hash: most pages have few or none of them

    out = F.when(F.col("_l_drop").isNull(), whole).otherwise(let(_lines(F.col("_l_text")), cleaned))
    return placed.withColumn("_l_out", F.when(F.col("_l_text").isNotNull(), out))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_share: float = 0.1, min_pages: int = 3, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with cleaned texts; ``length``, if there is such a column, becomes the new number of characters of changed texts."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_l_row")
    marked = _marked(docs, [whole], host, text, max_share, min_pages)

    def column(c):
        old = F.col("_l_row")[c]
        if c == text:
            return F.col("_l_out.text").alias(c)
        if c == length:
            return F.when(F.col("_l_out.dropped") > 0, F.length("_l_out.text").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return marked.select(*map(column, docs.columns))


def report(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_share: float = 0.1, min_pages: int = 3) -> DataFrame:
    """Per document: doc_id, n_dropped (lines), text (cleaned)."""
    marked = _marked(docs, [F.col(doc_id).alias("_l_id")], host, text, max_share, min_pages)
    return marked.select(F.col("_l_id").alias("doc_id"), F.coalesce(F.col("_l_out.dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.col("_l_out.text").alias("text"))
