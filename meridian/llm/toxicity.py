"""Toxicity: a logistic word model that is held to the same score when identity terms are swapped.

Every labelled text that mentions a group gets counterfactuals: each identity term is replaced by
the others of its kind, one after another.  The loss adds ``swap_weight`` times the mean squared difference of the two
log odds, and neutral sentences about each group, made from templates, count as examples that
aren't toxic.  So a mention of a group by itself doesn't move the score.

Features are a text's distinct lower-case words and the starts of its words (``^`` and 4, 5 or 6
letters: one stem has many endings) that enough sample texts hold, chosen by how far they shift the
odds; an insult in a long text counts as much as in a short one.  A quarter of the sample isn't
fitted but sets slope and intercept of the probabilities.  A text without known features (also an
empty or null one) has the score of the intercept.  Texts are scored whole, however long.  Null ids
have a null ``held_out``, as there is no remainder; they are never learned from.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling
from .common import batches

THRESHOLD = 0.7
#: Features of a model (None: all), and sample texts that must hold one; both parameters of ``fit``.
MAX_WORDS = 4000
MIN_TEXTS = 4
SWAP_WEIGHT = 5.0
RIDGE = 0.02

# Identity terms by kind; a term is swapped with the others of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
)
# Neutral sentences about a group.
TEMPLATES = ("my neighbours are {}", "{} people live here", "a {} family moved in", "she wrote about {} history")

#: Letters of the starts of words that are features.
STARTS = (4, 5, 6)
#: Words whose features a worker remembers.
REMEMBERED = 300_000

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def features_of(word: str) -> list[str]:
    return [word, *["^" + word[:n] for n in STARTS if len(word) > n]]


class Index:
    """Features known by a number; remembers those of the words it has met."""

    def __init__(self, names: Iterable[str]):
        self.of = {f: i for i, f in enumerate(names)}
        self.met: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: set[str]) -> set[int]:
        found: set[int] = set()
        met, get = self.met, self.met.get
        for w in words:
            ids = get(w)
            if ids is None:
                ids = tuple(i for f in features_of(w) if (i := self.of.get(f)) is not None)
                if len(met) >= REMEMBERED:
                    met.clear()
                met[w] = ids
            if ids:
                found.update(ids)
        return found


def words_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def swapped(words: set[str]) -> list[set[str]]:
    """The words with each identity term replaced by the next of its kind, by the one after that, and so on; none without a term."""
    mentioned = [(kind, i) for kind in IDENTITY for i, term in enumerate(kind) if term in words]
    rest = words.difference(*IDENTITY)
    most = max((len(kind) for kind, _ in mentioned), default=1)
    return [rest | {kind[(i + step) % len(kind)] for kind, i in mentioned} for step in range(1, most)]


def _select(rows: list[tuple[int, set[str]]], max_words: int | None, min_texts: int) -> list[str]:
    """The words whose presence shifts the odds most, by a z score of the log odds ratio."""
    n = Counter(y for y, _ in rows)
    df = {0: Counter(), 1: Counter()}
    for y, words in rows:
        df[y].update({f for w in words for f in features_of(w)})
    score = {}
    for w in df[0].keys() | df[1].keys():
        a, b = df[1][w], df[0][w]
        if a + b >= min_texts:
            odds = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((b + 0.5) / (n[0] - b + 0.5))
            score[w] = abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    best = sorted(score, key=lambda w: (-score[w], w))[:max_words]
    return sorted(set(best) | {t for kind in IDENTITY for t in kind})


def _matrix(sets: Iterable[set[str]], index: Index) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [], []
    for i, words in enumerate(sets):
        found = sorted(index(words))
        rows += [i] * len(found)
        cols += found
    return np.array(rows, np.int64), np.array(cols, np.int64)


def fit_texts(sample: list[tuple[int, str]], swap_weight: float = SWAP_WEIGHT, ridge: float = RIDGE, steps: int = 400, max_words: int | None = MAX_WORDS, min_texts: int = MIN_TEXTS) -> Model:
    """By gradient descent with momentum over the whole sample."""
    ys = {y for y, _ in sample}
    if ys != {0, 1}:
        share = (sum(y for y, _ in sample) + 1) / (len(sample) + 2)
        return Model((), (), float(np.log(share / (1 - share))))
    held = [(y, words_of(t)) for y, t in sample[3::4]]
    rows = [(y, words_of(t)) for i, (y, t) in enumerate(sample) if i % 4 != 3]
    if {y for y, _ in rows} != ys or {y for y, _ in held} != ys:
        held = rows = rows + held
    names = _select(rows, max_words, min_texts)
    index = Index(names)
    rows = rows + [(0, words_of(t.format(term))) for kind in IDENTITY for term in kind for t in TEMPLATES]
    y = np.array([float(v) for v, _ in rows])
    r, c = _matrix((w for _, w in rows), index)
    pairs = [(w, s) for _, w in rows for s in swapped(w)]
    pr, pc = _matrix((w for w, _ in pairs), index)
    sr, sc = _matrix((s for _, s in pairs), index)
    n, d, m = len(rows), len(names), max(len(pairs), 1)
    w, bias = np.zeros(d), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    df = np.bincount(c, minlength=d) / n
    scale = np.minimum(1 / np.maximum(0.25 * df, 1e-3), 200)  # a step for each word by its curvature
    speed, bias_speed = np.zeros(d), 0.0
    for _ in range(steps):
        z = np.bincount(r, weights=w[c], minlength=n) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(c, weights=g[r], minlength=d) / n + ridge * 0.01 * w
        gap = np.bincount(pr, weights=w[pc], minlength=m) - np.bincount(sr, weights=w[sc], minlength=m)
        pull = 2 * swap_weight * gap / m
        grad += np.bincount(pc, weights=pull[pr], minlength=d) - np.bincount(sc, weights=pull[sr], minlength=d)
        speed = 0.8 * speed - 0.1 * scale * grad
        bias_speed = 0.8 * bias_speed - 0.1 * g.mean()
        w, bias = w + np.clip(speed, -0.3, 0.3), bias + bias_speed
    r, c = _matrix((v for _, v in held), index)
    z = np.bincount(r, weights=w[c], minlength=len(held)) + bias
    slope, shift = _calibrate(z, np.array([float(v) for v, _ in held]))
    kept = [i for i in range(d) if w[i]]
    return Model(tuple(names[i] for i in kept), tuple(float(w[i] * slope) for i in kept), float(bias * slope + shift))


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds, by Newton's method; pulled to 1 and 0 so that separable examples don't send them off."""
    x, w, start = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    hold = np.diag([0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.clip(np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, x.T @ (p - y) + hold @ (w - start)), -0.5, 0.5)
    return float(min(max(w[0], 0.2), 10.0)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "toxic", rows: int = sampling.ROWS, max_bytes: int = sampling.BYTES, max_words: int | None = MAX_WORDS, min_texts: int = MIN_TEXTS, largest: int | None = None, swap_weight: float = SWAP_WEIGHT) -> Model:
    """Fits on a bounded sample of labelled rows (``rows``, ``max_bytes``, texts of at most ``largest`` bytes, by default a 64th of ``max_bytes``)
    for which ``where`` holds (all, if None).  Features are words and word starts that ``min_texts`` of its texts hold, the ``max_words`` most telling (None: all)."""
    return fit_texts(sampling.labelled_sample(docs, labels, label, where, rows, max_bytes, largest), swap_weight, max_words=max_words, min_texts=min_texts)


@functools.lru_cache(maxsize=2)
def _index(names: tuple[str, ...]) -> Index:
    return Index(names)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    index, weight = _index(model.names), model.weights
    z = [model.bias + sum([weight[i] for i in sorted(index(words_of(t)))]) for t in texts]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``, in its partitions: repeated rows are scored each, null texts as empty ones."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(model, batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches(run), "doc_id long, score double")
