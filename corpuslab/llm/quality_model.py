"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

A text's tokens (split at white space) are terms: each lower-cased word in them that is in the vocabulary, the token's shape (``Xx``, ``XX!!``, ``x***``, ``|`` and so on), and ``=``
where a token repeats the one before. Words and tokens over ``PIECE`` characters count as pieces of so many, and shapes over ``SIGNS`` signs as pieces of so many, each a term. Every
term has a sparse random index vector drawn from a hash of its name. A term's context vector is the sum of the index vectors of terms found within two tokens in the sample; its word
vector is the context vector at length 1 plus its own index vector at length 1 (without that, all terms share one direction and differ little). ``=`` is in others' contexts but has
none itself: its word vector is its index vector at length 1 plus that again. A document is the mean of its terms' vectors; the
network (tanh, then logistic) is trained on these by Adam, and one temperature, fitted on a part of the sample that the network does not see, scales its logit.

Bounds of the fit: ``rows`` labelled rows of at most ``max_chars`` characters, ``vocabulary`` words and ``shapes`` shapes. Scoring reads every whole text.

Cases: null and empty texts are the zero vector and get its score. With labels of one class only, every score is that class's share (0.5 without labels). Repeated
rows each get the same score; a score equal to the threshold (a tie) is predicted 1. Long texts are scored whole. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain, groupby, zip_longest
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .sample import training_sample
from .toxicity import scored, sigmoid

LETTERS = re.compile(r"[^\W\d_]+")
PIECE, SIGNS = 24, 8
MEMORY = 250_000
"""Tokens whose vectors a worker remembers."""


@dataclass(frozen=True)
class Settings:
    rows: int = 3_000
    max_chars: int = 100_000
    vocabulary: int = 8_000
    shapes: int = 500
    dimensions: int = 64
    nonzero: int = 6
    window: int = 2
    hidden: int = 32
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-4
    threshold: float = 0.5
    folds: int = 3
    held_out: int = 1


def words_of(token: str) -> list[str]:
    return [run[i : i + PIECE].lower() for run in LETTERS.findall(token) for i in range(0, len(run), PIECE)]


class Kinds(dict):
    """For ``str.translate``: X for capitals, x for other letters, 9 for digits, other signs as they are."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = ord("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c)
        return self[code]


KINDS = Kinds()


@functools.lru_cache(1 << 16)
def _runs(kinds: str) -> tuple[str, ...]:
    """Runs of capitals as one or two letters, of small letters and digits as one, of the same other sign as at most three; in pieces of ``SIGNS``."""
    out = "".join(kind * min(len(run), 2 if kind == "X" else 1 if kind in "x9" else 3) for kind, run in ((k, [*r]) for k, r in groupby(kinds)))
    return tuple(out[i : i + SIGNS] for i in range(0, len(out), SIGNS))


def shapes_of(token: str) -> list[str]:
    kinds = token.translate(KINDS)
    return [x for i in range(0, len(kinds), PIECE) for x in _runs(kinds[i : i + PIECE])]


def index_vector(term: str, s: Settings) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(term.encode()))
    v = np.zeros(s.dimensions, np.float32)
    v[rng.choice(s.dimensions, s.nonzero, replace=False)] = rng.choice([-1, 1], s.nonzero)
    return v


class TokenVectors(dict):
    """A token's row in ``sums`` (of the vectors of its terms) and ``pairs`` (how many pairs of a word and a shape it has)."""

    def __init__(self, model: Model):
        self.model, self.used = model, 0
        self.sums, self.pairs, self.long = np.zeros((MEMORY, model.vectors.shape[1]), np.float32), np.zeros(MEMORY, np.float32), []

    def __missing__(self, token: str) -> int:
        row = self.used
        pairs, vectors = self.model.terms(token), self.model.vectors
        if len(pairs) == 1:
            np.add(vectors[pairs[0][0]], vectors[pairs[0][1]], out=self.sums[row])
        else:
            self.sums[row] = vectors[np.array(pairs)].sum((0, 1))
        self.pairs[row] = len(pairs)
        self.used += 1
        self[token] = row
        if len(token) > PIECE:
            self.long.append(token)
        return row

    def places(self, tokens: list[str]) -> np.ndarray:
        """Rows of at most MEMORY different tokens; long ones are forgotten at once."""
        if self.used + len(tokens) > MEMORY:
            self.clear()
            self.used = 0
        out = np.fromiter(map(self.__getitem__, tokens), np.intp, len(tokens))
        for token in self.long:
            del self[token]
        self.long.clear()
        return out


@dataclass
class Model:
    place: dict[str, int]
    vectors: np.ndarray
    layers: tuple
    temperature: float
    _tokens: TokenVectors | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_tokens": None}

    def terms(self, token: str) -> list[tuple[int, int]]:
        """Places of a token's words and shapes, in pairs; the last place is a zero vector."""
        none = len(self.vectors) - 1
        words = [self.place.get("w:" + w, none) for w in words_of(token)]
        return list(zip_longest(words, [self.place.get("s:" + x, none) for x in shapes_of(token)], fillvalue=none))

    def pooled(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(self.vectors.shape[1], np.float32)
        if self._tokens is None:
            self._tokens = TokenVectors(self)
        own, count = self._tokens, Counter(tokens)
        different, n = list(count), np.fromiter(count.values(), np.float32, len(count))
        total, pairs = sum(map(eq, tokens, tokens[1:])) * self.vectors[self.place["="]], 0.0
        for k in range(0, len(different), MEMORY):
            at = own.places(different[k : k + MEMORY])
            total = total + n[k : k + MEMORY] @ own.sums[at]
            pairs += float(n[k : k + MEMORY] @ own.pairs[at])
        return total / np.float32(pairs)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(x @ w1 + b1) @ w2 + b2

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.logits(self.pooled(text)) / self.temperature))


@dataclass
class Constant:
    value: float

    def score(self, text: str | None) -> float:
        return self.value


class Terms(dict):
    """Terms of each token of the sample."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> list[tuple[int, int]]:
        self[token] = self.model.terms(token)
        return self[token]


def word_vectors(texts: list[str], s: Settings) -> tuple[dict[str, int], np.ndarray]:
    words, shapes = Counter(), Counter()
    for text in texts:
        for token, n in Counter(text.split()).items():
            for x in shapes_of(token):
                shapes[x] += n
            for w in words_of(token):
                words[w] += n
    top = lambda c, k: sorted(c, key=lambda x: (-c[x], x))[:k]
    names = ["=", *("w:" + w for w in top(words, s.vocabulary)), *("s:" + x for x in top(shapes, s.shapes))]
    place = {t: i for i, t in enumerate(names)}
    index = np.stack([index_vector(t, s) for t in names] + [np.zeros(s.dimensions, np.float32)])
    model, none = Model(place, index, (), 1.0), len(names)
    known = Terms(model)
    vectors = index.copy()
    for text in texts:
        tokens = text.split()
        if not tokens:
            continue
        parts = [*map(known.__getitem__, tokens)]
        at = np.array([*chain.from_iterable(parts)])
        starts = np.cumsum([*map(len, parts)])[:-1]
        near = index[at[:, 0]] + index[at[:, 1]]
        near[starts[np.fromiter(map(eq, tokens, tokens[1:]), bool, len(tokens) - 1)]] += index[0]
        context = np.zeros_like(near)
        for k in range(1, s.window + 1):
            context[k:] += near[:-k]
            context[:-k] += near[k:]
        for side in (0, 1):
            order = np.argsort(at[:, side], kind="stable")
            own, first = np.unique(at[order, side], return_index=True)
            vectors[own] += np.add.reduceat(context[order], first)
    vectors[none] = 0
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    # Random indexing leaves a direction that all terms share; without it, terms differ more.
    vectors[:none] += index[:none] / np.sqrt(s.nonzero)
    return place, vectors.astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple:
    """Two layers by Adam on the whole sample."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(d), (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, s.steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = (sigmoid(h @ p[2] + p[3]) - y) / len(y)
        gh = g[:, None] * p[2] * (1 - h * h)
        grads = [x.T @ gh + s.decay * p[0], gh.sum(0), h.T @ g + s.decay * p[2], g.sum()]
        for i, grad in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad**2
            p[i] = p[i] - s.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Of least log loss among a fixed row of values."""
    tried = np.geomspace(0.25, 8, 101)
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in tried]
    return float(tried[int(np.argmin(loss))])


def fit(sample: pa.Table, s: Settings = Settings()) -> Model | Constant:
    y = np.array(sample.column("label").to_pylist(), float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Constant(float(y.mean()) if len(y) else 0.5)
    texts = sample.column("text").to_pylist()
    place, vectors = word_vectors(texts, s)
    model = Model(place, vectors, (), 1.0)
    x = np.stack([model.pooled(t) for t in texts])
    own = np.arange(len(y)) % 5 != 0 if len(y) >= 50 else np.ones(len(y), bool)
    model.layers = train(x[own], y[own], s)
    unseen = ~own if len(set(y[~own])) == 2 else own
    model.temperature = temperature(model.logits(x[unseen]), y[unseen])
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fits on the labels outside the held-out fold and scores every document."""
    sample = training_sample(docs, labels, label, s.folds, s.held_out, s.rows, s.max_chars, doc_id, text)
    return scored(docs, fit(sample, s), s.threshold, s.folds, s.held_out, doc_id, text)
