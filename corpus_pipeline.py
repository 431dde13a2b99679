"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them again, so a lost executor repeats one stage at most.

Cases, of every stage: texts are read whole, of any length; an empty table stays empty; columns beside those of ``documents`` pass through under any name (the last stage returns its own only);
rows that are the same are decided alike. Ties are named at the stage that can have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import bpe, decontamination, line_dedup, near_dup, quality_rules
from corpuslab.llm.common import materialise, table


#: op8's fixed word limit is out of reach of texts without common words; this one follows each language's own distance for such a text.
QUALITY = quality_rules.Rules(max_bare_share=0.95)


#: op5's share leaves nearly all repeated lines; README says which ones this share still leaves.
MAX_LINE_SHARE = 0.01


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are. Null and empty texts fail the base rule. A verdict follows from text and language, so there are no ties."""
    return quality_rules.keep_good(docs, rules=QUALITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that too many pages of their source have; ``n_chars`` follows changed texts. Null texts stay null, a null source is a host of its own. A share equal to the limit keeps its line."""
    return line_dedup.drop_boilerplate(docs, max_share=MAX_LINE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. Documents without words or without an id all stay, and so do repeated rows of the kept one: ids and texts equal to its own are no ties."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those of whose words a twentieth or more lie in windows of the benchmark. Null and empty texts stay; exactly a twentieth goes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; null texts count as empty."""
    return bpe.digests(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dup", near_duplicates), ("decontamination", decontaminate), ("bpe", encode)]

#: The later stages (similarity on full shingle sets, byte-pair merges) can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
