import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or full rows."""

    def make(rows):
        full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    return [
        (None, "a text without an id but with some words in it", "en", "a", 5),
        (None, None, None, None, None),
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \t\n ", "de", None, 4),
        (4, "one two", "en", "b", 7),
        (5, "one two", "en", "b", 7),
        (5, "one two", "en", "b", 7),
        (6, "wörter ößä 😀 é  x y", "de", "b", 20),
        (7, "lang " * 30_000, "en", "c", 150_000),
        (-8, "minus eight has one line\nand another line here.", "en", "c", 40),
    ]


def prose(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies with a few or many edits, shared passages, and plain documents."""
    rng, rows = random.Random(7), []
    passage = prose(99, 60)
    for k in range(24):
        rows.append(prose(k, rng.randrange(3, 220)))
    for k in range(8):
        base = rows[k]
        for edits in (0, 1, 3, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append(copy)
    for _ in range(12):
        words = prose(rng.randrange(10**6), 80)
        at = rng.randrange(80)
        rows.append(words[:at] + passage + words[at:])
    rows.append(passage + passage)
    rng.shuffle(rows)
    return [(k, " ".join(words)) for k, words in enumerate(rows)]
