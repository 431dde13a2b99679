"""Toxicity by non-negative positive-unlabelled learning.

Positive examples P are the confirmed toxic rows of a bounded sample of labelled rows; the unlabelled text U is these rows, their labels unread, and a bounded sample of
documents without a label. A linear model of which words and beginnings of words a text has (each once, as sets) minimises
``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])`` with the logistic loss ``l`` and an L1 penalty; where the second term would be negative, its gradient is
turned, as in the non-negative estimator.

The labelled sample is dealt to three parts; each of three models does without one part and scores it. A logistic curve (Platt) fitted to these scores and labels, all of rows that
their model has not seen, turns f into a probability; a text's f is the mean of the three. Short first fits with the share of toxic labels as class prior give the prior of the real ones:
the mean probability of U, and the features of the real ones: those with a weight in any.

Bounds of the fit: ``rows`` labelled and ``unlabelled`` unlabelled rows of at most ``max_chars`` characters, ``vocabulary`` features. Scoring reads every whole text.

Cases: null and empty texts score as texts without words. Without a positive and a negative example every score is the share of toxic labels (0 without labels). Repeated rows
each get the same score; a score equal to the threshold (a tie) is predicted toxic. Long texts are scored whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .sample import fold, training_sample, unlabelled_sample

PARTS = 3
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    rows: int = 8_000
    unlabelled: int = 4_000
    max_chars: int = 100_000
    vocabulary: int = 30_000
    min_texts: int = 10
    steps: int = 200
    rate: float = 0.05
    l1: float = 2.2
    """By number of rows."""
    threshold: float = 0.3
    folds: int = 4
    held_out: int = 2


def features(text: str | None) -> set[str]:
    """Different words, and the first four and five letters of longer ones with a hyphen after: insults come in many endings."""
    found = set(WORD.findall((text or "").lower()))
    return found | {w[:4] + "-" for w in found if len(w) > 4} | {w[:5] + "-" for w in found if len(w) > 5}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    slope: float
    shift: float
    prior: float

    def score(self, text: str | None) -> float:
        f = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & features(text)))
        return float(sigmoid(self.slope * f + self.shift))


class Rows:
    """Sparse 0/1 matrix: products with a vector from either side."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.shape = len(sets), width
        lengths = np.array([len(s) for s in sets])
        column = np.concatenate(sets).astype(np.int32)
        order = np.argsort(column, kind="stable")
        row = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)[order].astype(np.intp)
        del order
        self.parts = []  # for each side: what to gather, the starts of its groups, and which groups there are
        for sizes, other in ((lengths, column.astype(np.intp)), (np.bincount(column, minlength=width), row)):
            own = np.flatnonzero(sizes)
            self.parts.append((other, (np.cumsum(sizes) - sizes)[own], own))

    def _product(self, side: int, v: np.ndarray) -> np.ndarray:
        gather, starts, own = self.parts[side]
        out = np.zeros(self.shape[side])
        if len(own):
            out[own] = np.add.reduceat(v.astype(np.float32).take(gather), starts)
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._product(0, v)

    def back(self, v: np.ndarray) -> np.ndarray:
        return self._product(1, v)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def risk(f: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores f, and the direction of descent's opposite by f. positive, unlabelled: weights of rows, each of sum 1.

    With the logistic loss l(z) = log(1 + e^-z), the slopes of l(f) and l(-f) are -sigmoid(-f) and sigmoid(f).
    """
    up, down = np.logaddexp(0, -f), np.logaddexp(0, f)
    rest = unlabelled @ down - prior * (positive @ down)
    g_rest = (unlabelled - prior * positive) * sigmoid(f)
    g = -prior * positive * sigmoid(-f) + g_rest if rest >= 0 else -g_rest
    return prior * (positive @ up) + max(0.0, rest), g


def nnpu(x: Rows, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias. Proximal Adam on all rows at once; deterministic."""
    _, width = x.shape
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        _, g = risk(x.times(w) + b, positive, unlabelled, prior)
        grad = np.append(x.back(g), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = s.rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
        step = rate * m / (1 - 0.9**t)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate[:-1] * s.l1 / x.shape[0])
        b -= step[-1]
    return w, b


def platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method, with the usual shrunk targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([f, np.ones_like(f)], 1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(x @ c)
        h = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (q - target) + 1e-4 * (c - [1, 0]))
        c -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(c[0]), float(c[1])) if c[0] > 0 else (1.0, 0.0)


def fit(sample: pa.Table, unlabelled: pa.Table | None = None, s: Settings = Settings()) -> Model:
    """sample: text, label; unlabelled: text."""
    label = np.array(sample.column("label").to_pylist(), float)
    if not len(label) or not 0 < label.sum() < len(label):
        share = label.mean() if len(label) else 0.0
        return Model({}, 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))), float(share))
    known = len(label)
    texts = [sample.column("text"), unlabelled.column("text")] if unlabelled is not None and unlabelled.num_rows else [sample.column("text")]
    ids: dict[str, int] = {}
    found = [np.fromiter((ids.setdefault(w, len(ids)) for w in features(t.as_py())), np.int32) for t in chain(*texts)]
    names, count = list(ids), np.zeros(len(ids), np.int64)
    for k in range(0, len(found), 500):
        count += np.bincount(np.concatenate(found[k : k + 500]), minlength=len(ids))
    chosen = sorted(np.flatnonzero(count >= s.min_texts), key=lambda i: (-count[i], names[i]))[: s.vocabulary]
    listed, at = [names[i] for i in chosen], np.full(len(names), -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    sets = [np.sort(own[own >= 0]) for own in (at[z] for z in found)]
    del ids, names, found
    x = Rows(sets, len(listed))
    toxic = np.append(label, np.zeros(x.shape[0] - known))
    part = np.arange(x.shape[0]) % PARTS
    prior = float(label.mean())
    for steps in (s.steps // 4, s.steps):
        scores, fits = np.zeros(x.shape[0]), []
        for k in range(PARTS):
            own, u = toxic * (part != k), (part != k).astype(float)  # rows to be scored are in neither
            own = own if own.any() else toxic  # a single positive
            fits.append(nnpu(x, own / own.sum(), u / u.sum(), prior, steps, s))
            scores[part == k] = (x.times(fits[-1][0]) + fits[-1][1])[part == k]
        w, b = np.mean([f[0] for f in fits], 0), float(np.mean([f[1] for f in fits]))
        slope, shift = platt(scores[:known], label)
        prior = float(np.clip(sigmoid(slope * scores + shift).mean(), 1e-4, 0.9))
        if steps < s.steps and w.any():  # features without a weight in any short fit are left out of the real ones
            used = np.flatnonzero(w)
            at = np.full(len(listed), -1, np.int32)
            at[used] = np.arange(len(used))
            listed, sets = [listed[i] for i in used], [own[own >= 0] for own in (at[z] for z in sets)]
            x = Rows(sets, len(listed))
    return Model({listed[i]: float(w[i]) for i in np.flatnonzero(w)}, b, slope, shift, prior)


def scored(docs: DataFrame, model, threshold: float, folds: int, held_out: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row. ``model.score`` takes a text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(F.col(doc_id), folds) == held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    schema = T.StructType([*narrow.schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            score = np.fromiter((own.score(t.as_py()) for t in batch.column(2)), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema.names)

    return narrow.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fits on the labels outside the held-out fold and scores every document."""
    sample = training_sample(docs, labels, label, s.folds, s.held_out, s.rows, s.max_chars, doc_id, text)
    rest = unlabelled_sample(docs, labels, label, s.folds, s.held_out, s.unlabelled, s.max_chars, doc_id, text)
    return scored(docs, fit(sample, rest, s), s.threshold, s.folds, s.held_out, doc_id, text)
