"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against every window of the corpus (DataFrame functions only).

Words are maximal runs of a-z, 0-9 and characters from U+0080, after A-Z are lower-cased. A window is ``n`` consecutive
words of an item; an item of fewer words (but not none) is one window of its own length. A document's windows of each length that an item has are hashed in
place and looked up in the set; each hit is verified word by word. A word is hit if any occurrence of a window holds it.

Cases: null or empty texts have no words, are never contaminated and stay; items without words are no windows. Items with equal
windows all count (ties). A null item id counts as a window's item but is not listed or counted. Repeated documents each get
the same result. Texts of any length are read whole. An empty table of documents gives an empty result, an empty benchmark hits nothing. Extra columns pass through ``decontaminate``.

Scale: what is broadcast is one 64-bit hash a window, for up to ``max_broadcast`` windows, which are counted first; only hits meet the windows' words. Hashes cover a window's
whole length, so a short item meets its own words only, however common its first ones are. Beyond the bound the documents' window hashes are shuffled against the benchmark's instead,
and hits are verified after a second join with the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, materialise, small

BROADCAST_HASHES = 2_000_000
"""Of 8 bytes each; some 64 MB as a hash relation."""
BROADCAST_KEYS = 200_000
BROADCAST_GRAMS = 100_000
"""Windows with their words and items, some 200 bytes each."""
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = 13) -> DataFrame:
    """item (string), gram (array of words): each distinct window of each item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    return items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(n)).alias("gram")).distinct()


def _key(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` and of so many words from ``at`` (counted from 0)."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _lookup(texts: DataFrame, grams: DataFrame, sizes: list[int], max_broadcast: int, max_bytes: int = 32 << 20) -> DataFrame:
    """Occurrences (``_d_id``, ``_d_key``, n_words, at, size, gram_id) of windows. grams: h, gram, size, gram_id; sizes: all that occur."""
    held = grams.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.array_join("gram", " "))), F.lit(0)).alias("bytes")).first()
    words, at, least = F.col("_d_words"), F.col("at"), min(sizes, default=1)
    starts = F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least)) if sizes else F.lit(None).cast("array<int>")
    placed = texts.select("_d_id", "_d_key", "_d_words", F.explode(starts).alias("at"))
    keys = [F.when(at + m <= F.size(words), _key(words, at, m)) for m in sizes]
    if len(sizes) == 1:
        hashed = placed.withColumn("h", keys[0]).withColumn("size", F.lit(sizes[0]))
    else:
        each = F.array(*[F.struct(F.lit(m).alias("size"), k.alias("h")) for m, k in zip(sizes, keys, strict=True)]) if sizes else F.array().cast("array<struct<size:int,h:bigint>>")
        hashed = placed.select("_d_id", "_d_key", "_d_words", "at", F.inline(each))
    hashes = grams.select("h").distinct()
    out = ["_d_id", "_d_key", "n_words", "at", "size", "gram_id"]
    n_words, found = F.size(words).cast("long").alias("n_words"), F.slice(words, at + 1, F.col("size")).alias("found")
    named = grams.withColumnRenamed("size", "_g_size")
    named = F.broadcast(named) if held["rows"] <= min(max_broadcast, BROADCAST_GRAMS) and held["bytes"] <= max_bytes else named
    if held["rows"] <= max_broadcast:
        hits = hashed.join(F.broadcast(hashes), "h", "left_semi").select("h", "_d_id", "_d_key", n_words, "at", "size", found)
        return hits.join(named, "h").filter("found = gram").select(*out)
    hits = hashed.select("_d_id", "_d_key", "at", "size", "h").join(named, "h")
    again = texts.select(F.col("_d_id").alias("_i"), F.col("_d_key").alias("_k"), "_d_words").dropDuplicates(["_i", "_k"])
    joined = hits.join(again, F.col("_d_id").eqNullSafe(F.col("_i")) & (F.col("_d_key") == F.col("_k")))
    return joined.filter(F.slice(words, at + 1, F.col("size")) == F.col("gram")).withColumn("n_words", n_words).select(*out)


def occurrences(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, max_broadcast: int = BROADCAST_HASHES):
    """(hits, grams): verified occurrences of windows, and the windows with the items that have them."""
    grams = (
        windows(benchmark, item_id, item_text, n)
        .groupBy("gram")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("gram_id", F.xxhash64(F.to_json("gram")))
    )
    sizes = [k for k in range(1, n + 1)]
    h = F.coalesce(*[F.when(F.size("gram") == k, _key(F.col("gram"), F.lit(0), k)) for k in sizes])
    grams = materialise(grams.withColumn("size", F.size("gram")).withColumn("h", h), "benchmark-windows")
    texts = docs.select(F.col(doc_id).alias("_d_id"), text_key(F.col(text)).alias("_d_key"), words_of(F.col(text)).alias("_d_words"))
    found = sorted(r["size"] for r in grams.select("size").distinct().collect())  # n at most
    return _lookup(texts, grams.drop("items"), found, max_broadcast), grams


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (at, size) spans."""

    def step(a, s):
        end = (s["at"] + s["size"]).cast("long")
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(s["at"].cast("long"), a["end"]))
        return F.struct((a["n"] + new).alias("n"), F.greatest(a["end"], end).alias("end"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def _spans(hits: DataFrame) -> DataFrame:
    """_d_id, _d_key, n_words, spans (sorted; no more than a text has words), gram_ids: one row for each text with a hit."""
    spans = hits.groupBy("_d_id", "_d_key").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"), F.collect_set("gram_id").alias("gram_ids"))
    return materialise(spans, "hits")


def _found(docs, benchmark, doc_id, text, item_id, item_text, n, max_broadcast) -> DataFrame:
    """_d_id, _d_key, spans, items (sorted): one row for each text with a hit."""
    hits, grams = occurrences(docs, benchmark, doc_id, text, item_id, item_text, n, max_broadcast)
    spans = _spans(hits)
    named = grams.select("gram_id", F.explode_outer("items").alias("item"))
    named = F.broadcast(named) if small(named, min(max_broadcast, BROADCAST_GRAMS)) else named
    items = (
        spans.select("_d_id", "_d_key", F.explode("gram_ids").alias("gram_id"))
        .join(named, "gram_id")
        .select(F.col("_d_id").alias("_i"), F.col("_d_key").alias("_k"), "item")
        .groupBy("_i", "_k")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return spans.join(items, F.col("_d_id").eqNullSafe(F.col("_i")) & (F.col("_d_key") == F.col("_k"))).select("_d_id", "_d_key", "spans", "items")


def _judged(docs, columns, benchmark, doc_id, text, item_id, item_text, n, max_broadcast, share) -> DataFrame:
    found = materialise(_found(docs, benchmark, doc_id, text, item_id, item_text, n, max_broadcast), "contaminated")
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.broadcast(found) if small(found, 2_000) else found
    base = docs.select(*columns, F.col(doc_id).alias("_e_id"), text_key(F.col(text)).alias("_e_key"), F.regexp_count(t, F.lit(WORD_ANY_CASE)).cast("long").alias("_e_words"))
    joined = base.join(found, F.col("_e_id").eqNullSafe(F.col("_d_id")) & (F.col("_e_key") == F.col("_d_key")), "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return joined.withColumn("_e_hit", n_hit).withColumn("_e_bad", (F.col("_e_hit") > 0) & (share * F.col("_e_hit") >= F.col("_e_words")))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, share: int = 20, max_broadcast: int = BROADCAST_HASHES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted strings), spans (first word, words), contaminated (at least 1/share of its words are hit)."""
    judged = _judged(docs, [], benchmark, doc_id, text, item_id, item_text, n, max_broadcast, share)
    empty = F.array().cast("array<string>")
    return judged.select(
        F.col("_e_id").alias("doc_id"),
        F.col("_e_words").alias("n_words"),
        F.col("_e_hit").alias("n_hit"),
        F.coalesce(F.col("items"), empty).alias("items"),
        F.col("spans"),
        F.col("_e_bad").alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, share: int = 20, remove: str = "documents", max_broadcast: int = BROADCAST_HASHES) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words and what stands between them cut out of those.

    Its columns are exactly those of ``docs``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    hits, _ = occurrences(docs, benchmark, doc_id, text, item_id, item_text, n, max_broadcast)
    bad = _spans(hits).filter(share * _covered(F.col("spans")) >= F.col("n_words")).select("_d_id", "_d_key", "spans")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_d_id")) & (text_key(F.col(f"`{text}`")) == F.col("_d_key"))
    if remove == "documents":  # only keys meet the documents
        keys = bad.select("_d_id", "_d_key")
        return docs.join(F.broadcast(keys) if small(keys, min(max_broadcast, BROADCAST_KEYS)) else keys, same, "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_e_row")
    keyed = docs.select(whole, F.col(doc_id).alias("_e_id"), text_key(F.col(text)).alias("_e_key"))
    bad = F.broadcast(bad) if small(bad, 2_000) else bad
    marked = keyed.join(bad, F.col("_e_id").eqNullSafe(F.col("_d_id")) & (F.col("_e_key") == F.col("_d_key")), "left")
    kept = marked.select("_e_row.*", F.col("spans").alias("_e_spans"))
    cut = F.when(F.col("_e_spans").isNotNull(), excise(F.col(f"`{text}`"), F.col("_e_spans"))).otherwise(F.col(f"`{text}`"))
    return kept.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def excise(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans``; what stands before and after a word that stays, stays."""
    words = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))
    gaps = F.split(text, WORD_ANY_CASE)
    hit = let(spans, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.exists(s, lambda x: (x["at"] <= i) & (i < x["at"] + x["size"]))))
    parts = let(
        F.struct(words.alias("w"), gaps.alias("g"), hit.alias("h")),
        lambda v: F.concat(
            F.transform(v["w"], lambda w, i: F.when(F.get(v["h"], i), F.when((i > 0) & F.get(v["h"], i - 1), F.lit("")).otherwise(F.get(v["g"], i))).otherwise(F.concat(F.get(v["g"], i), w))),
            F.array(F.get(v["g"], F.size(v["w"]))),
        ),
    )
    return F.array_join(parts, "")
