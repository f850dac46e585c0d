"""Toxicity by weak supervision.

Many voters look at a text: words of a small lexicon, words and word beginnings mined from
labelled documents, and patterns of writing. Each says toxic, clean or nothing. A generative
label model estimates by expectation maximization how often each voter says what for either
class, and how strongly voters depend on one another given the class; dependent voters share
their weight. Its posteriors are soft labels, on which a linear classifier over words and word
beginnings is trained. Only the classifier scores documents.

Labels are learned from documents outside the held-out fold. The fit uses a bounded sample,
at most ``PER_CLASS`` documents of each label value and ``UNLABELLED`` without a label.
The classifier is a table of ``FEATURES`` weights. Scoring is one pass over the
rows, without a shuffle; whole texts are read.

Edge cases: null and empty texts get the score of a text without words. Documents labelled
more than once count as toxic if any label says so; null labels and labels of unknown
documents are left out. Without toxic or without clean training rows every score is the share
of toxic ones (0 without any). Repeated rows get equal rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from sys import intern

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_texts

PER_CLASS = 1500
UNLABELLED = 1000
FEATURES = 1200
RIDGE = 0.3
TRUST = 0.995
BEGINNINGS = (4, 5, 6, 7, 8)
MINED = 160
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")

# Plain insults of four languages, one voter each.
LEXICON = [
    "idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
    "dumb", "fool", "jerk", "imbecile", "garbage",
    "dumm", "arschloch", "trottel", "abschaum", "wertlos",
    "connard", "imbécile", "ordure", "minable", "dégoûtant",
    "idiota", "imbécil", "estúpido", "basura", "asqueroso",
]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[str]:
    """The word and its beginnings; a bar marks a beginning."""
    return [word, *(word[:n] + "|" for n in BEGINNINGS if len(word) >= n)]


def _repeats(words: set[str]) -> list[tuple[str, int]]:
    """(term, k) for every term that k or more words of the set hold, k up to 3."""
    return [(t, k) for t, n in Counter(t for w in words for t in terms_of(w)).items() for k in (1, 2, 3) if n >= k]


def mine(sets: list[set[str]], labels: np.ndarray) -> list[tuple[str, int]]:
    """Terms whose presence in so many distinct words speaks for toxic, best first."""
    toxic, clean = int(labels.sum()), max(1, int((labels == 0).sum()))
    seen: Counter = Counter()
    for words, y in zip(sets, labels, strict=True):
        if y:
            seen.update(_repeats(words))
    often = {t: n for t, n in seen.items() if n >= max(3, 0.004 * toxic)}
    elsewhere: Counter = Counter()
    for words, y in zip(sets, labels, strict=True):
        if not y:
            elsewhere.update(t for t in _repeats(words) if t in often)
    rated = []
    for term, n in often.items():
        precision = (n / toxic) / (n / toxic + elsewhere[term] / clean + 0.5 / clean)
        if precision > 0.85:
            rated.append((-(2 * precision - 1) * n, term))
    return [term for _, term in sorted(rated)[:MINED]]


class Voters:
    """Votes on a text: 1 toxic, -1 clean, 0 nothing."""

    def __init__(self, mined: list[tuple[str, int]]) -> None:
        self.mined = mined

    def __len__(self) -> int:
        return len(LEXICON) + len(self.mined) + 4

    def votes(self, text: str, words: set[str]) -> list[int]:
        counted = Counter(t for w in words for t in terms_of(w))
        lexicon = [int(w in words) for w in LEXICON]
        mined = [int(counted[term] >= k) for term, k in self.mined]
        letters = sum(map(str.isalpha, text))
        patterns = [
            int(letters > 20 and sum(map(str.isupper, text)) > 0.7 * letters),  # shouting
            int(text.count("!") > 0.02 * max(1, len(text))),
            -1 if not any(lexicon) and not any(mined) else 0,
            -1 if len(words) < 5 and not any(lexicon) else 0,
        ]
        return lexicon + mined + patterns


class LabelModel:
    """P(vote | class) of every voter, and the weight dependence leaves it."""

    def __init__(self, prior: float, tables: np.ndarray, weights: np.ndarray) -> None:
        self.prior, self.tables, self.weights = prior, tables, weights

    @staticmethod
    def _tables(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """By voter, class and vote: smoothed shares."""
        out = np.empty((votes.shape[1], 2, 3))
        for y, mass in ((0, 1 - posterior), (1, posterior)):
            for v in (-1, 0, 1):
                out[:, y, v + 1] = mass @ (votes == v) + 0.3
        return out / out.sum(axis=2, keepdims=True)

    @staticmethod
    def _dependence(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        """Each voter's share of what it says, given how it goes along with others within a class."""
        total = np.zeros((votes.shape[1], votes.shape[1]))
        for mass in (posterior, 1 - posterior):
            centered = (votes - np.average(votes, axis=0, weights=mass + 1e-9)) * np.sqrt(mass)[:, None]
            total += centered.T @ centered
        spread = np.sqrt(np.maximum(np.diag(total), 1e-9))
        correlation = np.clip(total / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(correlation, 1)
        correlation[correlation < 0.15] = 0
        return 1 / correlation.sum(axis=1)

    @classmethod
    def fit(cls, votes: np.ndarray, known: np.ndarray, prior: float, rounds: int = 15) -> LabelModel:
        """``known`` is 0 or 1 for labelled rows, -1 for others."""
        labelled = known >= 0
        said = (votes > 0).any(axis=1)
        posterior = np.where(labelled, known, np.where(said, 0.7, prior)).astype(float)
        model = cls(prior, cls._tables(votes[labelled], posterior[labelled]), np.ones(votes.shape[1]))
        for _ in range(rounds):
            posterior = np.where(labelled, known, model.posterior(votes))
            model = cls(prior, cls._tables(votes, posterior), cls._dependence(votes, posterior))
        return model

    def posterior(self, votes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of each row; a given label is one more voter, right as often as ``TRUST``."""
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        if known is not None:
            odds += np.where(known >= 0, np.where(known > 0, 1, -1) * np.log(TRUST / (1 - TRUST)), 0)
        ratio = np.log(self.tables[:, 1] / self.tables[:, 0]) * self.weights[:, None]
        for v in (-1, 0, 1):
            odds += (votes == v) @ ratio[:, v + 1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Classifier:
    """A logistic score, linear in how many distinct words of a text hold each term."""

    def __init__(self, bias: float, weights: dict[str, float]) -> None:
        self.bias, self.weights = float(bias), weights
        self.memory: dict[str, float] = {}

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "memory": {}}

    @classmethod
    def fit(cls, sets: list[set[str]], soft: np.ndarray) -> Classifier:
        """Newton steps on the soft labels, over the terms that tell the classes apart most."""
        mean = float(soft.mean())
        seen: Counter = Counter()
        for words, y in zip(sets, soft, strict=True):
            if y >= 0.5:
                seen.update({t for w in words for t in terms_of(w)})
        often = {t for t, n in seen.items() if n >= 3}
        del seen
        with_term: Counter = Counter()
        toxic_with: Counter = Counter()
        for words, y in zip(sets, soft, strict=True):
            terms = {t for w in words for t in terms_of(w)} & often
            with_term.update(terms)
            for t in terms:
                toxic_with[t] += y
        # By the chi-square of presence against the soft label.
        rated = sorted((-((toxic_with[t] - n * mean) ** 2) / n, t) for t, n in with_term.items())
        chosen = {t: k for k, (_, t) in enumerate(rated[:FEATURES])}
        rows = np.zeros((len(sets), len(chosen) + 1))
        rows[:, -1] = 1
        for row, words in zip(rows, sets, strict=True):
            for t in (t for w in words for t in terms_of(w)):
                if t in chosen:
                    row[chosen[t]] += 1
        weights = np.zeros(len(chosen) + 1)
        weights[-1] = np.log(mean / (1 - mean))
        ridge = np.full(len(weights), RIDGE)
        ridge[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
            slope = rows.T @ (p - soft) + ridge * weights
            bend = (rows.T * np.maximum(p * (1 - p), 1e-6)) @ rows + np.diag(ridge)
            step = np.linalg.solve(bend, slope)
            weights -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        return cls(weights[-1], {t: float(weights[k]) for t, k in chosen.items()})

    def word(self, word: str) -> float:
        weight = self.memory.get(word)
        if weight is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            weight = self.memory[word] = sum(self.weights.get(t, 0.0) for t in terms_of(word))
        return weight

    def score(self, text: str) -> float:
        odds = self.bias + sum(sorted(filter(None, map(self.word, words_of(text)))))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, odds)))))


def fit(rows: list[tuple[str, int]]) -> Classifier:
    """From texts with label 0 or 1, or -1 for none."""
    known = np.array([y for _, y in rows])
    labelled = known >= 0
    toxic = int((known == 1).sum())
    if not toxic or toxic == labelled.sum():
        share = min(1 - 1e-9, max(1e-9, toxic / max(1, int(labelled.sum()))))
        return Classifier(np.log(share / (1 - share)), {})
    sets = [set(map(intern, words_of(text))) for text, _ in rows]
    voters = Voters(mine([s for s, y in zip(sets, labelled, strict=True) if y], known[labelled]))
    votes = np.array([voters.votes(text, words) for (text, _), words in zip(rows, sets, strict=True)])
    model = LabelModel.fit(votes, known, toxic / labelled.sum())
    return Classifier.fit(sets, model.posterior(votes, known))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on a bounded sample of documents outside the held-out fold."""
    spark = docs.sparkSession
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    given = ids.join(told.where(F.col("label").isin(0, 1)), "doc_id", "left").select("doc_id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
    # Ids first: the sample is bounded, so its texts come by a broadcast join.
    chosen = bounded_sample(given.where("label >= 0"), "label", PER_CLASS, 2, "toxic:") + bounded_sample(given.where("label < 0"), "label", UNLABELLED, 1, "toxic:")
    sample = spark.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], "sample_id long, label int")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id"))
    rows = sorted(tuple(r) for r in texts.select("doc_id", "text", "label").collect())
    return fit([(text, label) for _, text, label in rows])


def score(docs: DataFrame, labels: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = model or train(docs, labels)
    scored = map_texts(docs, lambda: lambda texts: [[model.score(t) for t in texts]], "score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Classifier | None = None) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    model = model or train(docs, labels)
    carried = docs.select(F.struct("*").alias("row"), "text")
    scored = map_texts(carried, lambda: lambda texts: [[model.score(t) for t in texts]], "score double", carry=("row",))
    return scored.where("score < 0.5").select("row.*")
