"""Topics: reduced embeddings, clusters, class-based TF-IDF labels, and topics over time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import terms


def embedded(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], name: str = "embedding") -> DataFrame:
    """df with a vector a text. ``load`` makes the model, once in each worker's task; the model turns the texts of an Arrow batch into rows of a matrix. Null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series(list(np.asarray(model(s.fillna("").tolist()), np.float32)), dtype=object)

    return df.withColumn(name, run(F.col(text).cast("string")))


class HashedWords:
    """A model without training: words are hashed to a dimension and a sign, and added up."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.known = dimensions, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, t in zip(out, texts, strict=True):
            for w in re.findall("[a-zà-ÿ]{3,}", t.lower()):
                at, sign = self._place(w)
                row[at] += sign
        return out

    def _place(self, word: str) -> tuple[int, int]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            digest = hashlib.md5(word.encode()).digest()
            self.known[word] = digest[0] % self.dimensions, 1 if digest[1] % 2 else -1
        return self.known[word]


def reduced(df: DataFrame, vector: str, dimensions: int = 50) -> DataFrame:
    """Adds ``reduced``: principal components of the centred vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    steps = [StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False), PCA(k=dimensions, inputCol="_c", outputCol="reduced")]
    with_vector = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return Pipeline(stages=steps).fit(with_vector).transform(with_vector).drop("_v", "_c")


def clusters(df: DataFrame, vector: str = "reduced", k: int = 25, seeds: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``topic``: K-means, the cheapest of ``seeds`` runs."""
    from pyspark.ml.clustering import KMeans

    held = df.select(vector).persist()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol=vector, predictionCol="topic").fit(held) for i in range(seeds)]
    finally:
        held.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost).transform(df)


def class_tfidf(df: DataFrame, topic: str, found: Column, most: int = 20_000, parts: int | None = None) -> DataFrame:
    """topic, term, n, weight. A topic is one document: (1 + ln n) times ln((1 + topics) / (1 + topics with the term)) + 1, rows of length 1.

    The vocabulary is the ``most`` most frequent terms, ties by name. ``parts``: as for ``terms.counts``.
    """
    counted = terms.counts(df, found, topic, parts=parts)
    vocabulary = counted.groupBy("term").agg(F.sum("n").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(most)
    size = df.select(topic).distinct().agg(F.count("*").alias("topics"))
    raw = counted.join(vocabulary, "term").join(F.broadcast(size))  # one row
    weighted = raw.withColumn("raw", (1 + F.log("n")) * (F.log((1 + F.col("topics")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(topic)))
    return weighted.select(topic, "term", "n", (F.col("raw") / norm).alias("weight"))


def topic_words(weighted: DataFrame, topic: str, stop: list[str] = (), n: int = 10) -> DataFrame:
    """The first words of each topic. Stop words are cut as whole features, so pairs that hold one stay."""
    kept = weighted.filter(~F.col("term").isin(list(stop))) if stop else weighted
    return terms.top(kept, [topic], [F.desc(F.round("weight", 9)), F.asc("term")], n)


def topic_labels(words: DataFrame, topic: str, n: int = 5) -> DataFrame:
    first = F.sort_array(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "term"))))
    return words.groupBy(topic).agg(F.array_join(F.transform(first, lambda x: x["term"]), " | ").alias("label"))


def over_time(df: DataFrame, topic: str, period: Column) -> DataFrame:
    """period, topic, n, pct of the period."""
    n = df.groupBy(period.alias("period"), topic).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("period")))
