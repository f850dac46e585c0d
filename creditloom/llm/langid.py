"""Language identification with a blended-spectrum string kernel.

The kernel of two texts blends, over n-gram lengths 1 to 4, the cosine of their sets of
n-grams (presence, not counts; lower-cased letters with one space between words). A bounded
sample of labelled documents is drawn on the driver; some of them are Nystroem landmarks, and
one kernel ridge regression per language (one versus the rest) is solved in the space the
landmarks span. Presence vectors are hashed to ``BUCKETS`` positions per n-gram length, so a
batch is scored by two matrix products: presence by landmarks, then landmarks by languages.
The first depends only on the landmarks' fixed matrix, so both are folded into one weight
matrix before it goes to the executors; its size is ``4 * BUCKETS`` by languages, whatever
the input.

Training uses about ``PER_LANGUAGE`` documents and ``LANDMARKS`` landmarks of every language,
none of a held-out fold. More than ``LANGUAGES`` languages share what so many would get, but
each has ``LEAST_DOCUMENTS`` and ``LEAST_LANDMARKS`` where there are so many; none is left out. Scoring is one pass over the rows, without a shuffle.

Edge cases: a null text or one without letters is ``und`` with score 0. Without any labelled
document every text is ``und``. Repeated rows get equal rows. Ties go to the first language
by code point. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_texts, share

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 13
PER_LANGUAGE = 400
LANGUAGES = 64  # with a full share of documents and landmarks
LANDMARKS = 100  # per language
LEAST_DOCUMENTS = 20
LEAST_LANDMARKS = 4
RIDGE = 1e-3
SHARPNESS = 8.0

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)


def present(text: str) -> np.ndarray | None:
    """Positions of the text's n-grams, ascending; None for a text without letters."""
    letters = _NOT_LETTERS.sub(" ", text.lower())
    if not any(map(str.isalpha, letters)):
        return None
    codes = np.frombuffer(f" {letters.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    flags = np.zeros(len(LENGTHS) * BUCKETS, bool)
    rolled = np.zeros(len(codes), np.uint64)
    for k in LENGTHS:
        if k > len(codes):
            break
        rolled = (rolled[: len(codes) - k + 1] + codes[k - 1 :]) * _STEPS[k - 1]
        mixed = rolled ^ (rolled >> np.uint64(29))
        mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 13)
        flags[(mixed % np.uint64(BUCKETS)).astype(np.int64) + (k - 1) * BUCKETS] = True
    return np.flatnonzero(flags)


def blended(positions: list[np.ndarray]) -> np.ndarray:
    """One row per text: presence, scaled so that a product of two rows is their kernel."""
    rows = np.zeros((len(positions), len(LENGTHS) * BUCKETS), np.float32)
    for row, found in zip(rows, positions, strict=True):
        row[found] = 1.0
    blocks = rows.reshape(len(positions), len(LENGTHS), BUCKETS)
    sizes = np.sqrt(blocks.sum(axis=2, keepdims=True))
    np.divide(blocks, np.sqrt(len(LENGTHS)) * np.maximum(sizes, 1), out=blocks)
    return rows


class Model:
    """Languages and one column of weights for each."""

    def __init__(self, languages: list[str], weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Model:
        found = [(p, y) for p, y in ((present(t), y) for t, y in zip(texts, labels, strict=True)) if p is not None]
        languages = sorted({y for _, y in found})
        if not found:
            return cls([], np.zeros((len(LENGTHS) * BUCKETS, 0), np.float32))
        rows = blended([p for p, _ in found])
        at = {name: k for k, name in enumerate(languages)}
        column = np.array([at[y] for _, y in found])
        truth = np.where(column[:, None] == np.arange(len(languages)), 1.0, -1.0)
        each = share(LANDMARKS, LANGUAGES, len(languages), LEAST_LANDMARKS)
        marks = rows[np.concatenate([np.flatnonzero(column == k)[:each] for k in range(len(languages))])]
        # Nystroem: features are kernels to the landmarks, whitened by the landmarks' own kernel.
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        usable = values > 1e-7 * values[-1]
        whiten = vectors[:, usable] / np.sqrt(values[usable])
        features = (rows @ marks.T).astype(np.float64) @ whiten
        features = np.hstack([features, np.ones((len(rows), 1))])
        # Languages weigh alike, however many documents each has.
        weight = 1.0 / np.bincount(column)[column]
        gram = (features.T * weight) @ features + RIDGE * len(languages) / max(1, len(found)) * np.eye(features.shape[1])
        solved = np.linalg.solve(gram, (features.T * weight) @ truth)
        return cls(languages, np.vstack([marks.T @ (whiten @ solved[:-1]), solved[-1:]]).astype(np.float32))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        positions = [present(t) for t in texts]
        known = [i for i, p in enumerate(positions) if p is not None]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known or not self.languages:
            return names, scores
        margins = blended([positions[i] for i in known]) @ self.weights[:-1] + self.weights[-1]
        # A softmax of the margins: 0 to 1, and the same order.
        raised = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)).astype(np.float64))
        best = margins.argmax(axis=1)
        sure = raised[np.arange(len(best)), best] / raised.sum(axis=1)
        for i, b, s in zip(known, best, sure, strict=True):
            names[i], scores[i] = self.languages[b], float(s)
        return names, scores


def train(docs: DataFrame) -> Model:
    """Fit on text and lang of documents outside the held-out fold."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sample = bounded_sample(labelled, "lang", PER_LANGUAGE, LANGUAGES, "lang:", LEAST_DOCUMENTS)
    return Model.fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = model or train(docs)
    scored = map_texts(docs, lambda: model.predict, "lang_pred string, score double", rows=128)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
