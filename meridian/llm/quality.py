"""Quality by compression: zstandard dictionaries built from good and from bad labelled texts.

A text is compressed once with either dictionary.  The normalised difference of the two sizes,
``(bad - good) / max(bad, good)``, says which kind it shares more strings with; a logistic curve
fitted on labelled texts outside the dictionaries turns it into a probability.  The curve has a
second input, how far the text compresses without a dictionary, as junk that repeats itself or
never repeats anything moves the difference without moving the label.  ``plain=False`` leaves it out.

Null ids have a null ``held_out``, as there is no remainder; they are never learned from.  Null and
empty texts have the score of equal sizes.  Texts are scored whole, however long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling
from .common import batches

DICT_BYTES = 112_640
LEVEL = 3
#: Training texts are handed to the dictionary builder in pieces of this size, all of them.
PIECE_BYTES = 8192
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    level: int
    weights: tuple[float, ...]


@functools.lru_cache(maxsize=4)
def _compressors(model: Model):
    import zstandard

    own = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) if d else None for d in (model.good, model.bad)]
    for d in own:
        if d is not None:
            d.precompute_compress(level=model.level)
    return [zstandard.ZstdCompressor(level=model.level, write_content_size=False, write_checksum=False, **({"dict_data": d} if d is not None else {})) for d in (*own, None)]


def features(model: Model, text: str | None) -> list[float]:
    """Of a whole text; an empty or null text has sizes that don't differ."""
    raw = (text or "").encode()
    good, bad, plain = (len(c.compress(raw)) for c in _compressors(model))
    return [1.0, (bad - good) / max(bad, good, 1), plain / (len(raw) + 32), np.log1p(len(raw)) / 10]


def _expand(x: np.ndarray, plain: bool = True) -> np.ndarray:
    d, r, n = x[:, 1], x[:, 2] * plain, x[:, 3] * plain
    return np.stack([np.ones(len(x)), d, r, n, d * n, r * r, np.sign(d) * np.sqrt(np.abs(d))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * len(x) * np.eye(x.shape[1]) / 10
        g = x.T @ (p - y) + ridge * len(x) * w / 10
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _slices(text: str) -> list[bytes]:
    """A whole text in pieces."""
    raw = text.encode()
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too small pieces
        return b"\n".join(pieces)[-size:]


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "quality", dict_bytes: int = DICT_BYTES, level: int = LEVEL, rows: int = sampling.ROWS, max_bytes: int = sampling.BYTES, largest: int | None = None, balanced: bool = True) -> Model:
    """Fits on a bounded sample of labelled rows (``rows``, ``max_bytes``, texts of at most ``largest`` bytes, by default a 64th of ``max_bytes``) for which ``where`` holds (all, if None).

    ``balanced``: both dictionaries are trained on about as many bytes, so pieces of the class with more text are left out of its
    dictionary (not of the calibration); else on all pieces.

    With one class only, or none, scores are that class's share (0.5 without examples).
    """
    sample = sampling.labelled_sample(docs, labels, label, where, rows, max_bytes, largest)
    return fit_texts(sample, dict_bytes, level, balanced=balanced)


def fit_texts(sample: list[tuple[int, str]], dict_bytes: int = DICT_BYTES, level: int = LEVEL, plain: bool = True, balanced: bool = True) -> Model:
    ys = {y for y, _ in sample}
    if ys != {0, 1}:
        share = (sum(y for y, _ in sample) + 1) / (len(sample) + 2)
        return Model(b"", b"", level, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    built, rest = sample[0::2], sample[1::2]
    if {y for y, _ in built} != {0, 1} or {y for y, _ in rest} != {0, 1}:
        built = rest = sample
    by = {k: [p for y, t in built if y == k for p in _slices(t)] for k in (0, 1)}
    least = min(sum(map(len, v)) for v in by.values())  # as many bytes for either class, else the larger one knows more strings
    for v in by.values() if balanced else ():
        total = sum(map(len, v))
        while len(v) > 1 and total - len(v[-1]) >= least:
            total -= len(v.pop())
    bare = Model(_dictionary(by[1], dict_bytes), _dictionary(by[0], dict_bytes), level, ())
    x = _expand(np.array([features(bare, t) for _, t in rest]), plain)  # weights of zero for what is left out
    w = _logistic(x, np.array([float(y) for y, _ in rest]))
    return Model(bare.good, bare.bad, level, tuple(float(v) for v in w))


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    x = _expand(np.array([features(model, t) for t in texts]).reshape(-1, 4))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``, in its partitions: repeated rows are scored each, null texts as empty ones."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(model, batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches(run), "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores ``threshold`` or more."""
    at = docs.columns.index("text")
    schema = docs.schema

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(score_texts(model, batch.column(at).to_pylist()) >= threshold))

        yield from batches(chosen)(incoming)

    return docs.mapInArrow(run, schema)
