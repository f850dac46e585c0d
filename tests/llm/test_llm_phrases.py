"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from creditloom.llm import phrases

TINY = {"shard": 300, "unit": 700, "vocabulary": 7, "transitions": 25, "slots": 400, "buckets": 40}


def plain(rows, least, top=2000, longest=5):
    words, counts = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(found[i : i + size])) for i in range(len(found) - size + 1))
    frequent = {k: f for k, f in counts.items() if f >= least}
    out = []
    for (lang, phrase), a in frequent.items():
        if len(phrase) < 2:
            continue
        held = any(
            other == lang and len(longer) > len(phrase) and 100 * f >= 100 * a and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
            for (other, longer), f in frequent.items()
        )
        if not held:
            cuts = []
            for k in range(1, len(phrase)):
                left, right = frequent[lang, phrase[:k]], frequent[lang, phrase[k:]]
                cuts.append((1000 * a * words[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.append((lang, -score, -a, " ".join(phrase).encode(), left, right, words[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n, -score))
    return sorted(ranked)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    fixed = [["new", "york", "city"], ["a", "b", "a", "b", "a"], ["Über", "uns", "alle"], ["one", "two", "three", "four", "five", "six"]]
    rows = []
    for k in range(160):
        words = []
        for _ in range(rng.randrange(80)):
            words += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice("the of and to in x y z q".split())]
            if rng.random() < 0.1:
                words[-1] += rng.choice(".,;:!?\n\r\x0b")
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
        rows.append((text, ("en", "de", None, "und")[k % 4]))
    return rows + [("a " * 900, "en"), ("", "en"), (None, "fr"), ("\t \n", None), ("tab\ttab\ttab one two", "fr")]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "c") for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, rank int, phrase string").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("least", "sizes"), [(9, {}), (9, TINY), (3, {"shard": 50, "unit": 60, "slots": 1})])
def test_equals_plain_counting(spark, prose, least, sizes):
    got = found(phrases.collocations(frame(spark, prose), least=least, **sizes))
    assert got and got == plain(prose, least)


def test_limits(spark, prose):
    got = found(phrases.collocations(frame(spark, prose), least=9, top=3, longest=3))
    assert got == plain(prose, 9, 3, 3)


def test_nothing_frequent(spark):
    assert found(phrases.collocations(frame(spark, []))) == []
    assert found(phrases.collocations(frame(spark, [("a b c", "en")]))) == []
    assert found(phrases.collocations(frame(spark, [("a. b! " * 200, "en")]))) == []


def test_names_are_sent_once_a_task(spark, prose, monkeypatch):
    """A phrase that every shard holds is named once per task and slice of buckets, not once per shard."""
    sent = []
    named = phrases.Walk.named

    def counted(walk, *args):
        df = named(walk, *args)
        sent.append((walk.shards.count(), df.count()))
        return df

    monkeypatch.setattr(phrases.Walk, "named", counted)
    rows = [("one two three four five six. " * 20, "en")] * 60
    got = found(phrases.collocations(frame(spark, rows), least=9, shard=50))
    assert got == plain(rows, 9)
    assert sent and all(shards > 60 and named <= phrases.LANES for shards, named in sent)


def test_scores_past_64_bits(spark):
    """The expression that scores a cut is exact where products need more than 64 bits."""
    rng = random.Random(4)
    rows = [tuple(rng.randrange(10**e, 10 ** (e + 1)) for e in (12, 12, 13, 16)) for _ in range(200)]
    table = spark.createDataFrame(rows, "a long, l long, r long, n long").selectExpr("*", *(f"CAST({c} AS DECIMAL(18,0)) AS d{c}" for c in "alrn"))
    table = table.selectExpr("*", "CAST(1000 AS DECIMAL(4,0)) * (da * dn) AS over", "dl * dr AS under").selectExpr("a", "l", "r", "n", "over div under AS score")
    for a, left, right, n, score in table.collect():
        assert score == 1000 * a * n // (left * right)


def test_trie_equals_a_dictionary():
    rng = np.random.default_rng(3)
    for size, states, letters in ((1, 1, 1), (40, 3, 60), (3000, 50, 4000), (20000, 9000, 300)):
        pairs = np.unique(np.stack([rng.integers(5, 5 + states, size), rng.integers(1, letters + 1, size)], 1), axis=0)
        trie = phrases.Trie(pairs[:, 0], pairs[:, 1], 70)
        asked_state = rng.integers(1, 10 + states, 20000)
        asked_word = np.concatenate([rng.integers(0, letters + 40, 20000)])
        at, slots = trie.step(np.arange(20000), asked_state, asked_word)
        known = set(map(tuple, pairs.tolist()))
        assert at.tolist() == [i for i in range(20000) if (asked_state[i], asked_word[i]) in known]
        named = {}
        for i, slot in zip(at.tolist(), slots.tolist(), strict=True):
            assert named.setdefault(slot, (asked_state[i], asked_word[i])) == (asked_state[i], asked_word[i])
        at, all_slots = trie.step(np.arange(len(pairs)), pairs[:, 0], pairs[:, 1])
        assert len(np.unique(all_slots)) == len(pairs) and 0 < all_slots.min() and all_slots.max() < trie.size - 1


def test_shards_and_sums_are_squeezed(spark):
    """Shards took four bytes a word, places eight, and each bucket of a task a row of its own."""
    rng = np.random.default_rng(5)
    numbers = np.sort(rng.integers(0, 1 << 31, 1000)).astype(np.int32)
    for steps in (False, True):
        assert phrases.unsqueezed(phrases.squeezed(numbers, steps), steps).tolist() == numbers.tolist()
        assert phrases.unsqueezed(phrases.squeezed(numbers[:0], steps), steps).tolist() == []
    place = phrases.Place(phrases.squeezed(np.arange(1, 3000)))
    again = phrases.Place(*place.saved(phrases.squeezed(np.arange(1, 3000))))
    assert again.at.tolist() == place.at.tolist() and again.states.tolist() == place.states.tolist()
    docs = spark.createDataFrame([("one two three four five six. " * 500, "en")], "text string, lang string").selectExpr("lang", "cast(text as binary) AS text").coalesce(1)
    known = [{"en": {w: k + 1 for k, w in enumerate(b"one two three four five six".split())}}]
    shards = [r.words for r in phrases.write_shards(docs, known, 100000).collect()]
    assert sum(len(phrases.unsqueezed(w)) for w in shards) == 3500 and sum(map(len, shards)) < 3500
    counted = {(r.lang, r.word): r.f for r in phrases.count_words(docs).collect()}
    assert counted == {("en", None): 3000} | {("en", w): 500 for w in "one two three four five six".split()}
