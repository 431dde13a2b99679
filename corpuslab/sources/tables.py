"""Sources and sinks: CSV as it comes, renamed and labelled loads, landed JSON and XML, caches, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators.scratch import saved

POST_COLUMNS = "tweet_id handle account date year month text likes retweets replies quotes views lang".split()
ARTICLE_COLUMNS = "url year month title domain text word_count source_file".split()


CSV = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """record (text of one CSV record, with the line ends inside its quotes) and first (whether it is the first of its file).

    Files are read by byte ranges, as lines. Quotes are doubled inside quoted fields and fields with quotes are quoted, so a line end is inside quotes exactly if the number of
    quotes before it in the file is odd. That number's parity is added up over the ranges of a file (a row a range), then within each range over its lines. What of a record lies in a later
    range is joined to the range where the record starts; only such records are shuffled a second time.
    """
    m = F.col("_metadata")
    read = spark.read.text(path, lineSep="\n").select("value", m["file_path"].alias("f"), m["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = read.withColumn("q", (F.length("value") - F.length(F.translate("value", '"', ""))) % 2)
    # of each range: its parity, and where it first turns; it has a record's start unless it begins inside quotes and ends there or with the line that leaves them
    of_range = lines.groupBy("f", "b").agg((F.sum("q") % 2).alias("odd"), F.min(F.when(F.col("q") == 1, F.col("i"))).alias("turn"), F.max("i").alias("end"))
    file = Window.partitionBy("f").orderBy("b")
    inside = F.coalesce(F.sum("odd").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    known = of_range.withColumn("inside", inside).withColumn("starts", (F.col("inside") == 0) | F.coalesce(F.col("turn") < F.col("end"), F.lit(False)))
    owner = F.last(F.when(F.col("starts"), F.col("b")), True).over(file.rowsBetween(Window.unboundedPreceding, -1))
    known = known.select("f", "b", "inside", owner.alias("owner"))
    by = Window.partitionBy("f", "b").orderBy("i")
    at = lines.join(known, ["f", "b"]).withColumn("before", (F.col("inside") + F.coalesce(F.sum("q").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2)
    numbered = at.withColumn("k", F.sum((F.col("before") == 0).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]), "\n")
    whole = numbered.groupBy("f", "b", "k").agg(text.alias("record"), F.max("owner").alias("owner"), ((F.max("inside") + F.sum("q")) % 2).alias("open"), F.sum("q").alias("quotes"))
    # k = 0: the rest of an earlier range's record; an odd number of quotes: a record that goes on in the next range
    done, parts = whole.filter("k > 0 and quotes % 2 = 0"), whole.filter("k = 0 or quotes % 2 = 1")
    piece = F.struct("b", "record")
    mended = parts.groupBy("f", F.when(F.col("k") == 0, F.col("owner")).otherwise(F.col("b")).alias("o")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["record"]), "\n").alias("record"), F.max(F.when(F.col("k") == 1, F.col("b"))).alias("only")
    )
    first = (F.col("b") == 0) & (F.col("k") == 1)
    out = done.select("record", first.alias("first")).unionAll(mended.select("record", ((F.col("o") == 0) & (F.coalesce("only", F.lit(-1)) == 0)).alias("first")))
    return out.withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record <> ''")


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, quoted fields over several lines, doubled quotes, fields of any size; a byte-order mark is no part of the first name.

    Every file starts with a header of these names, else the query fails. A file of any size is read by as many tasks as it has byte ranges.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = lambda text: F.from_csv(text, schema, CSV)
    names = parsed(F.regexp_replace("record", "^\ufeff", ""))
    wrong = F.raise_error(F.concat(F.lit("not the header that was expected: "), F.substring("record", 1, 1000))).cast("boolean")
    is_header = F.when(F.col("first"), F.when(names == F.struct(*[F.lit(c).alias(c) for c in columns]), True).otherwise(wrong)).otherwise(False)
    return csv_records(spark, path).filter(~is_header).select(parsed(F.col("record")).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def typed(df: DataFrame, dates: dict[str, str] = {}, numbers: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Empty text for null, timestamps by format, numbers and booleans; what can't be read is null."""
    out = df.na.fill("")
    for c, f in dates.items():
        out = out.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(f)))
    for c in numbers:
        out = out.withColumn(c, F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double"))
    for c in flags:
        out = out.withColumn(c, F.lower(c).isin("true", "1", "1.0", "yes"))
    return out


def labelled(df: DataFrame, label: str, priority: int) -> DataFrame:
    """The standard columns, trimmed, with the domain made even."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return df.select(
        t("url").alias("url"), t("year").alias("year"), t("month").alias("month"), t("title").alias("title"), U.domain(F.col("domain"), t("url")).alias("domain"),
        t("text").alias("text"), X.safe_int(F.col("word_count")).alias("word_count"), F.lit(label).alias("source_file"), F.lit(priority).alias("src_priority"), "pos",
    )


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def hub(df: DataFrame, category: Column, allowed: list[str], text: str, source: Column, least_words: int = 30) -> DataFrame:
    """Rows of an allowed category with enough words, and a source."""
    return df.filter(F.lower(F.trim(category)).isin(allowed) & (F.size(X.words(F.col(text))) >= least_words)).withColumn("source", F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("unknown")))


def url_column(columns: list[str], candidates: tuple[str, ...] = ("url", "article_url", "link", "DocumentIdentifier")) -> str:
    """A candidate, else the first name that holds 'url'."""
    found = [c for c in candidates if c in columns] or [c for c in columns if "url" in c.lower()]
    if not found:
        raise ValueError(f"no URL column among {columns}")
    return found[0]


def sitemap(spark: SparkSession, path: str, tag: str = "url") -> DataFrame:
    """loc, lastmod of a landed sitemap; ``tag='sitemap'`` for an index."""
    schema = "loc string, lastmod string"
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


ENTRIES = "array<struct<loc:string,lastmod:string>>"


def sitemap_tree(landed: DataFrame, roots: DataFrame, depth: int = 3, url: str = "url", xml: str = "xml") -> DataFrame:
    """sitemap, depth, loc, lastmod: what the sitemaps list that are reached from ``roots`` (column ``url``) by way of indexes, at most ``depth`` steps away.

    landed: fetched documents (url, xml). Level by level: the documents of a frontier are found by a join, and what their indexes name is the next frontier, without what was visited.
    Each sitemap is read once, at its least depth, however many indexes (or itself) name it; an index lists sitemaps only; what was not fetched or can't be parsed lists nothing.
    """
    parsed = F.from_xml(F.col(xml), f"sitemap {ENTRIES}, url {ENTRIES}", {"mode": "PERMISSIVE"})
    trimmed = lambda c: F.filter(F.transform(F.coalesce(c, F.from_json(F.lit("[]"), ENTRIES)), lambda e: F.struct(F.trim(e["loc"]).alias("loc"), F.trim(F.coalesce(e["lastmod"], F.lit(""))).alias("lastmod"))), lambda e: e["loc"] != "")
    documents = landed.groupBy(F.col(url).alias("sitemap")).agg(F.min(xml).alias(xml)).select("sitemap", parsed.alias("p")).select("sitemap", trimmed(F.col("p.sitemap")).alias("children"), trimmed(F.col("p.url")).alias("entries"))
    documents = saved(documents)
    frontier = saved(roots.select(F.col(url).alias("sitemap")).distinct())
    visited, read = frontier, None
    for level in range(depth + 1):
        here = documents.join(frontier, "sitemap")
        found = here.filter(F.size("children") == 0).select("sitemap", F.lit(level).alias("depth"), F.explode("entries").alias("e")).select("sitemap", "depth", "e.loc", "e.lastmod")
        read = found if read is None else read.unionAll(found)
        if level < depth:
            named = here.select(F.explode("children").alias("c")).select(F.col("c.loc").alias("sitemap")).distinct()
            frontier = saved(named.join(visited, "sitemap", "left_anti"))
            if frontier.isEmpty():
                break
            visited = visited.unionAll(frontier)
    return read


def institutions(payloads: DataFrame, column: str) -> DataFrame:
    """Landed JSON lists of institutions, one row for each id."""
    rows = payloads.select(F.explode(F.from_json(column, "array<struct<id_institucion:long,nombre_institucion:string,acronym:string,id_tipo:long>>")).alias("r")).select("r.*")
    return rows.filter("id_institucion is not null").groupBy("id_institucion").agg(*[F.min(c).alias(c) for c in ("nombre_institucion", "acronym", "id_tipo")])


def documents_of(raw: DataFrame, base: str, first_year: int = 2015) -> DataFrame:
    """Landed document rows (text columns) as records; no id 0, no year before the first."""
    doc_id, year = X.safe_int(F.col("id_documents")), X.safe_year(F.col("year"))
    url = F.coalesce(F.nullif(F.col("file_url"), F.lit("")), X.document_url(doc_id, base))
    rows = raw.withColumns({"_id": doc_id, "_y": year, "_u": url}).filter((F.col("_id") != 0) & F.coalesce(F.col("_y") >= first_year, F.lit(True)))
    return rows.select(
        F.col("_id").alias("id_documents"), F.col("_y").alias("year"), F.substring(F.coalesce("name", F.lit("")), 1, 500).alias("name"), X.safe_int(F.col("downloads")).alias("downloads"),
        F.col("_u").alias("file_url"), F.col("document_file_name_anexo").isNotNull().alias("has_annex"), X.extension(F.col("_u")).alias("file_extension"),
    )


def repaired(broken: DataFrame, live: DataFrame, archive: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """Texts of broken rows from a landed live fetch, else from a landed archive fetch, with where they came from."""
    a, b = (d.select(url, F.col(text).alias(n)) for d, n in ((live, "_live"), (archive, "_archive")))
    got = broken.drop(text).join(a, url, "left").join(b, url, "left").withColumn(text, F.coalesce("_live", "_archive"))
    return got.filter(F.col(text).isNotNull()).withColumn("repaired_from", F.when(F.col("_live").isNotNull(), "live").otherwise("archive")).drop("_live", "_archive")


def cached_vectors(spark: SparkSession, df: DataFrame, text: str, path: str, make) -> DataFrame:
    """df with ``embedding``, computed by ``make`` (rows to rows with ``embedding``) for texts that the cache has not; the cache is keyed by content."""
    keyed = df.withColumn("text_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    if exists(spark, path):
        cache = spark.read.parquet(path)
        missing = keyed.join(cache, "text_key", "left_anti")
    else:
        missing = keyed
    make(missing.dropDuplicates(["text_key"])).select("text_key", "embedding").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).dropDuplicates(["text_key"]), "text_key", "left").drop("text_key")


def write_csv(df: DataFrame, path: str, columns: list[str], append: bool = False) -> None:
    """The named columns, extras ignored; blanks and line ends around values stay."""
    df.select(*columns).write.mode("append" if append else "overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pages_cache(df: DataFrame, url: str, html: str, path: str) -> None:
    """Raw pages by safe name, as a table."""
    df.select(X.safe_name(F.col(url)).alias("name"), url, html).write.mode("append").parquet(path)
