"""Bounded samples of rows for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def _first(found: DataFrame, docs: DataFrame, rows: int, doc_id: str, text: str) -> pa.Table:
    """The texts of the first ``rows`` of ``found`` (_s_id and more) by a hash of their ids. Ids are chosen before any text is read."""
    ids = found.withColumn("_s_h", F.xxhash64("_s_id")).orderBy("_s_h", "_s_id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("_s_doc"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(ids), F.col("_s_doc") == F.col("_s_id"))
    return joined.orderBy("_s_h", "_s_id", "text").limit(rows).drop("_s_doc", "_s_id", "_s_h").toArrow()


def _ids(docs: DataFrame, max_chars: int, doc_id: str, text: str) -> DataFrame:
    return docs.filter(F.length(F.col(text)) <= max_chars).select(F.col(doc_id).alias("_s_doc"))


def _labelled(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    kept = labels.select(F.col(doc_id).alias("_s_id"), F.col(label).cast("int").alias("label")).filter(F.col("_s_id").isNotNull() & F.col("label").isNotNull())
    return kept.groupBy("_s_id").agg(F.max("label").alias("label"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> pa.Table:
    """text, label of at most ``rows`` labelled documents outside the held-out fold, by a hash of their ids.

    A label given twice counts as its largest value; null labels, ids and texts are no examples. Of texts of over ``max_chars`` characters none is in the
    sample; they are left out before rows are counted, so others take their places.
    """
    ids = _labelled(labels, label, doc_id).filter(fold(F.col("_s_id"), folds) != held_out)
    ids = F.broadcast(ids) if small(ids) else ids
    found = _ids(docs, max_chars, doc_id, text).join(ids, F.col("_s_doc") == F.col("_s_id")).select("_s_id", "label").distinct()
    return _first(found, docs, rows, doc_id, text)


def unlabelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, max_chars: int, doc_id: str = "doc_id", text: str = "text") -> pa.Table:
    """text of at most ``rows`` documents without a label outside the held-out fold, by a hash of their ids; long texts as in ``training_sample``."""
    ids = _labelled(labels, label, doc_id).select("_s_id")
    ids = F.broadcast(ids) if small(ids) else ids
    found = _ids(docs, max_chars, doc_id, text).filter(F.col("_s_doc").isNotNull() & (fold(F.col("_s_doc"), folds) != held_out))
    found = found.join(ids, F.col("_s_doc") == F.col("_s_id"), "left_anti").select(F.col("_s_doc").alias("_s_id"))
    return _first(found, docs, rows, doc_id, text)
