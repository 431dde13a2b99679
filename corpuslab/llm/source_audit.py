"""Source divergence audit: how far the sources of a language differ in their words, by an inverted index of corrections to a common baseline.

A group is a (lang, source), and its share of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)): V the language's terms, N the group's occurrences of them. The
divergence of two shares is f(p, q) = floor((p - q)^2 / (p + q)), and two groups are as far apart as the sum of f over all V terms. Nearly all counts are zero, so

1. a pair starts at V times f(z, y), z and y being the shares of a count of zero in its two groups;
2. a term that one group has corrects that by f(p, y) - f(z, y), as if the other group had none. This depends on the count alone, so a group's terms are first
   summed up as a histogram of counts;
3. a term's postings correct what 2 gets wrong for two groups that both have it: f(p, q) - f(p, y) - f(z, q) + f(z, y); what comes to zero is not emitted.

Everything is an integer: products beyond 64 bits are decimals of 38 digits, and divisions are whole.

Cases: null text, lang and source are ''. A group without terms, or of a language without kept terms (V = 0), is still compared: its value is the sum, 0 if V = 0. Repeated rows count
as documents of their own. Texts are read whole, of any length. Ties are in order of items' UTF-8 bytes. An empty table gives no rows; other columns are not read.

Scale: occurrences are summed within Arrow batches, then in map tasks, before they are shuffled. A language's groups are dealt to blocks of at most ``members``, and a unit of work
is a term (or a histogram) in two blocks, so a term that every source has is never one group; the corrections of a unit are added up where they are made. The number of pairs
is that of the result, and the ranks of one group's items are those of its language's sources, or of ten terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, small

NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    min_docs: int = 10
    """Documents of the language that have a kept term, at least."""
    top: int = 10
    members: int = 256
    """Groups of a block, on average."""


def _term_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """terms, and for each (row, term): row, index of the term, occurrences."""
    # what is split by characters that are no part of a term leaves terms and, at the ends, nothing
    words = pc.split_pattern_regex(pc.ascii_lower(texts), NOT_TERM)
    row, term = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words).dictionary_encode()
    code = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(len(term.dictionary), 1)
    pair, n = np.unique(row * size + code, return_counts=True)
    return term.dictionary, pair // size, pair % size, n


def occurrences(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, row, term, n = _term_counts(batch.column(2))
            keys = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            groups, where = _groups(keys)
            size = max(len(terms), 1)
            both, at, docs_n = np.unique(where[row] * size + term, return_inverse=True, return_counts=True)
            kept = pc.not_equal(terms.take(pa.array(both % size)), "") if len(both) else pa.array([], pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(groups[both // size])),
                    batch.column(1).take(pa.array(groups[both // size])),
                    terms.take(pa.array(both % size)),
                    pa.array(np.bincount(at, n, len(both)).astype(np.int64)),
                    pa.array(docs_n.astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
            yield out.filter(kept)

    partial = docs.select(part("lang"), part("source"), part("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(keys: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key a row that has it; for each row the number of its key."""
    seen: dict[tuple, int] = {}
    first, where = [], np.zeros(len(keys), np.int64)
    for i, k in enumerate(zip(keys.field(0).to_pylist(), keys.field(1).to_pylist(), strict=True)):
        where[i] = seen.setdefault(k, len(seen))
        if len(seen) > len(first):
            first.append(i)
    return np.array(first, np.int64), where


def share(count: Column, n: Column, v: Column) -> Column:
    """10^9 (count + 2) passes 64 bits at nine billion occurrences."""
    top, bottom = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (n + 2 * v).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, bottom).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """Shares are at most 10^9 + 1, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


@dataclass(frozen=True)
class Index:
    """groups: lang, source, n (N), v (V), z (share of a count of zero). postings: lang, source, term, count, p. terms: lang, term, total."""

    groups: DataFrame
    postings: DataFrame
    terms: DataFrame


def index(docs: DataFrame, s: Settings = Settings()) -> Index:
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))  # a row a source
    with bounded_batches(docs.sparkSession, rows=2048, size=8 << 20):
        found = occurrences(docs).withColumn("docs", everywhere).filter(F.col("docs") >= s.min_docs)
        kept = materialise(found.select("lang", "source", "term", F.col("n").alias("count")), "kept-terms")
    terms = materialise(kept.groupBy("lang", "term").agg(F.sum("count").alias("total")), "terms")
    n = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    v = _by_lang(terms.groupBy("lang").agg(F.count("*").alias("v")))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    zero = F.lit(0).cast("long")
    groups = docs.select(part("lang"), part("source")).distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"))
    groups = materialise(groups.withColumn("z", F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v")))), "groups")
    postings = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "count", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "z")
    return Index(groups, materialise(postings, "postings"), terms)


def _by_lang(df: DataFrame) -> DataFrame:
    """A row a language; as long as these are few, what is joined with them isn't dealt by language."""
    return F.broadcast(df) if small(df) else df


def _blocked(df: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """Each row once for every pair of blocks (i, j) that its own block (blk) is in."""
    dealt = df.join(blocks, "lang").withColumn("blk", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("lang", *columns, "blk", other).select("lang", *columns, "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))


def _met(a: str, b: str) -> Column:
    """Of a unit of two blocks the pairs across them, of one block all; each once, in order of sources."""
    return (F.col(f"{a}.source") < F.col(f"{b}.source")) & ((F.col(f"{a}.i") == F.col(f"{a}.j")) | (F.col(f"{a}.blk") != F.col(f"{b}.blk")))


def pairs(ix: Index, s: Settings = Settings()) -> DataFrame:
    """lang, a, b (a < b), value: every two groups of a language."""
    blocks = ix.groups.groupBy("lang").agg(F.ceil(F.count("*") / s.members).cast("int").alias("blocks"))
    blocks = _by_lang(blocks)
    groups = _blocked(ix.groups, blocks, "source", "v", "z")
    unit = lambda *more: [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("lang", "i", "j", *more)]
    f = lambda p, q: divergence(F.col(p), F.col(q))
    start = groups.alias("x").join(groups.alias("y"), [*unit(), _met("x", "y")])
    base = start.select("x.lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.coalesce(F.col("x.v") * f("x.z", "y.z"), F.lit(0)).alias("value"))

    histogram = _blocked(ix.postings.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("terms")), blocks, "source", "p", "z", "terms")
    other = (F.col("x.source") != F.col("y.source")) & ((F.col("x.i") == F.col("x.j")) | (F.col("x.blk") != F.col("y.blk")))
    alone = histogram.alias("x").join(groups.alias("y"), [*unit(), other])
    one = F.col("x.terms") * (f("x.p", "y.z") - f("x.z", "y.z"))
    single = alone.select("x.lang", F.least("x.source", "y.source").alias("a"), F.greatest("x.source", "y.source").alias("b"), one.alias("value"))

    postings = _blocked(ix.postings, blocks, "source", "term", "p", "z")
    shared = postings.alias("x").join(postings.alias("y"), [*unit("term"), _met("x", "y")])
    two = f("x.p", "y.p") - f("x.p", "y.z") - f("x.z", "y.p") + f("x.z", "y.z")
    double = shared.select("x.lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), two.alias("value"))

    corrections = single.unionAll(double).filter("value <> 0")
    return base.unionAll(corrections).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank. Pairs: every other source of the language. Terms: the ``top`` that the group has more of than its language."""
    ix = index(docs, s)
    two = pairs(ix, s)
    both = two.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(two.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    order = ["lang", "source", "part", "item", "value", "rank"]
    pair_rows = both.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(ranked)}).select(order)

    totals = _by_lang(ix.terms.groupBy("lang").agg(F.sum("total").alias("n"), F.count("*").alias("v")))
    whole = ix.terms.join(totals, "lang").select("lang", "term", share(F.col("total"), F.col("n"), F.col("v")).alias("q"))
    more = ix.postings.join(whole, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    term_rows = more.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= s.top).withColumn("part", F.lit("term")).select(order)
    return pair_rows.unionAll(term_rows)
