"""Plans are what they are meant to be: narrow scans, pushed filters, limited ranks, no Python, no cartesian products of tables."""

import re

import pytest

from corpuslab.plans import catalogue

SF = "/root/testdata/sf0.001"
PYTHON = {"html_article", "dedup_greedy", "topic_clusters", "report_topic_accounts", "composed_texts", "embedded_texts"}


def plan(spark, name):
    return catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [("tok_counts", {"text", "source"}), ("crosstab_pct", {"source", "lang"}), ("monthly_volume", {"o_orderdate"}), ("median_month", {"o_orderdate", "o_totalprice"}), ("html_title", {"page_id", "html"})])
def test_scans_read_what_is_used(spark, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name)))))
    assert read == columns


def test_filters_reach_the_scan(spark):
    text = plan(spark, "membership")
    assert "In(source, [src1,src2])" in text and "EqualTo(quality,1)" in text


@pytest.mark.parametrize("name", ["distinctive_words", "bigram_top20", "heat_share"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["top_sources", "topk_largest", "keyword_shift", "vectorizer_vocab"])
def test_first_rows_are_taken_without_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - PYTHON))
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)


@pytest.mark.parametrize("name, scans", [("cosine_before_after", 1), ("logodds_fixedvocab", 0), ("distinctive_words", 1), ("heat_share", 1)])
def test_tokens_are_found_once(spark, name, scans):
    """Scans that run: those that are not below a reused exchange, after adaptive execution; none where counts were written before."""
    df = catalogue.queries()[name](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet|Scan parquet", text.replace("FileScan parquet", "Scan parquet"))) - text.count("ReusedExchange") <= scans


@pytest.mark.parametrize("name", ["distinctive_bigrams", "distinctive_words", "ctfidf", "topic_labels"])
def test_terms_are_made_once(spark, name):
    """All that reads the counts shares one shuffle of them: no filter that only one side has goes below it."""
    df = catalogue.queries()[name](spark, SF)
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Generate explode") == 1


@pytest.mark.parametrize("name", ["bigram_top20", "distinctive_bigrams", "analysis_bigrams_top", "analysis_bigrams_outlets"])
def test_pairs_are_made_by_compiled_code(spark, name):
    """No function of array elements makes pairs, and they are counted in the stage that makes them, by one table."""
    df = catalogue.queries()[name](spark, SF)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "zip_with" not in text and re.search(r"\*\(\d+\) Generate explode\(arrays_zip", text)
    assert re.search(r"HashAggregate\(keys=\[(?:_key|_groupingexpression)#\d+\], functions=\[partial_count", text)


def test_terms_of_topics_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpuslab.operators import terms

    want = sorted(map(tuple, catalogue.queries()["ctfidf"](spark, SF).collect()))
    monkeypatch.setattr(terms, "BYTES_A_TASK", 20_000)
    n = terms.parts(spark.read.parquet(f"{SF}/documents.parquet"), "text")
    assert n > 10 and plan(spark, "ctfidf").count("hashpartitioning(term") == 2 and f", {n}), REPARTITION_BY_NUM" in plan(spark, "ctfidf")
    assert sorted(map(tuple, catalogue.queries()["ctfidf"](spark, SF).collect())) == want


def test_pages_are_parsed_once_in_small_batches(spark):
    """One worker a task for both texts of a page."""
    text = plan(spark, "html_article")
    assert text.count("ArrowEvalPython") == 1 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_firsts_are_found_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from corpuslab.operators import dedup

    df = spark.createDataFrame([(i, "" if i % 2 else f"http://x/{i % 7}", f"title of many letters {i % 3}", "w " * 60, i) for i in range(200)], "src_priority int, url string, title string, text string, pos int").withColumn("domain", F.lit("d"))
    for out in (dedup.by_url(df), dedup.cascade(df, F.col("url"), F.col("title"), [F.col("pos")])):
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    curated = dedup.curate(df, [])
    plan = curated._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan
    reasons = {r.pos: r.reject_reason for r in curated.collect()}
    assert all(reasons[i] == "no_url" for i in range(1, 200, 2)) and reasons[0] == "kept" and reasons[14] == "url" and sum(v == "kept" for v in reasons.values()) == 3
