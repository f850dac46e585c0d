"""Operators that compare documents, against brute force in small blocks and buckets."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from creditloom.llm import anchors, graph, jaccard, suffixes

SMALL = {"block_bytes": 1500, "bucket_keys": 64}


def windows_removed(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        yield i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def test_passages(frame, corpus, odd):
    rows = corpus + [(r[0] if r[0] is None else r[0] - 1000, r[1]) for r in odd] + [(5000, corpus[0][1]), (None, corpus[1][1])]
    got = anchors.remove_repeats(frame(rows), ["doc_id"], **SMALL).select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, windows_removed(rows)))
    assert any(r.n_removed for r in got)
    kept = anchors.shortened(frame(corpus).withColumn("block", anchors.F.lit(1)).withColumn("row", anchors.F.lit("x")))
    assert kept.columns[-2:] == ["block", "row"] and kept.count() == len(corpus)
    same = {r.doc_id: r.text for r in kept.collect()}
    assert all(same[i] == t for (i, t), (_, _, lost, _) in zip(corpus, windows_removed(corpus), strict=True) if not lost)
    assert anchors.digests(frame([])).count() == 0


def ties_removed(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        yield i, len(b), sum(gone), spans, sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_suffixes(frame, corpus, odd):
    assert suffixes.cover_is_complete()
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdéß ") for _ in range(700))
    rows = corpus + [(r[0] if r[0] is None else r[0] - 1000, r[1] if len(r[1] or "") < 1000 else r[1][:3000]) for r in odd]
    for k in range(20):
        cut = rng.randrange(380, 700)
        rows.append((6000 + k, "".join(rng.choice("xyz ") for _ in range(rng.randrange(300))) + passage[700 - cut :] + str(k)))
    rows += [(7000, passage + passage), (7001, "ab" * 500), rows[3], rows[3]]
    got = suffixes.remove_ties(frame(rows), ["doc_id"], **SMALL)
    got = got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", anchors.F.sha2("kept", 256)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ties_removed(rows, 400)))
    assert suffixes.digests(frame([])).count() == 0


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    for k, (i, s) in enumerate(sets):
        ids = [x for x in least[find(k)] if x is not None]
        yield i, len(s), min(ids) if ids else None


@pytest.mark.parametrize("part_tokens", [1 << 16, 150])
def test_jaccard(frame, corpus, odd, part_tokens):
    rows = corpus + [(r[0] if r[0] is None else r[0] - 1000, r[1]) for r in odd] + [(9000, corpus[5][1].upper()), (None, corpus[6][1])]
    got = jaccard.match(frame(rows), part_tokens=part_tokens, **SMALL).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, classes(rows)))
    assert len({r.component_id for r in got}) < len(rows) - 10


def test_chain_of_near_copies(frame):
    """Sets that link only to their neighbours are one component."""
    words = [f"v{k}" for k in range(600)]
    rows = [(100 - k, " ".join(words[7 * k : 7 * k + 100])) for k in range(60)]
    got = jaccard.match(frame(rows), part_tokens=300, **SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(classes(rows)) and {r.component_id for r in got} == {41}


def test_many_near_copies(frame):
    """A large group of near copies, some too far off to link to most others."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for k in range(160):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4))):
            copy[rng.randrange(90)] = f"e{k}_{rng.randrange(5)}"
        rows.append((k, " ".join(copy)))
    got = jaccard.match(frame(rows), part_tokens=1200, **SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(classes(rows))


@pytest.mark.parametrize("part_tokens", [1 << 16, 300])
def test_links(frame, corpus, odd, part_tokens):
    """Every link counts, also of three and more near copies whose component is known."""
    rng, base = random.Random(13), [f"b{k}" for k in range(60)]
    rows = corpus + [(r[0] if r[0] is None else r[0] - 1000, r[1]) for r in odd] + [(9000, corpus[5][1].upper()), (None, corpus[6][1])]
    for k in range(50):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 1, 2))):
            copy[rng.randrange(60)] = f"e{k}"
        rows.append((10_000 + k, " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    want = [sum(1 for j, y in enumerate(sets) if j != i and x and y and 100 * len(x & y) >= 75 * len(x | y)) for i, x in enumerate(sets)]
    got = jaccard.count_links(frame(rows), part_tokens=part_tokens, **SMALL).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*c, n)) for c, n in zip(classes(rows), want, strict=True))
    assert max(want) > 20
    different = {frozenset((frozenset(x), frozenset(y))) for i, x in enumerate(sets) for y in sets[:i] if x and y and x != y and 100 * len(x & y) >= 75 * len(x | y)}
    made = jaccard.shingle_sets(frame(rows), **SMALL)
    assert jaccard.set_pairs(made, part_tokens).distinct().count() == jaccard.set_pairs(made, part_tokens).count() == len(different)


@pytest.mark.parametrize("block_bytes", [1500, 1 << 20])
def test_null_id_beside_copies(frame, block_bytes):
    """A null id comes first of its copies in a block; the copies still link to near ones."""
    words = [f"n{k}" for k in range(100)]
    near = " ".join(words[:99])
    rows = [(None, " ".join(words)), (5, " ".join(words)), (7, near), (8, " ".join(words[:98])), (None, "other text")]
    got = jaccard.match(frame(rows), block_bytes=block_bytes).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, classes(rows)))
    assert {r.doc_id for r in jaccard.keep_one(frame(rows)).collect()} == {None, 5}


def test_passages_of_any_id(frame, corpus):
    ids = [(1 << 63) - 1, 1 << 62, (1 << 62) - 1, 0, -1, -(1 << 62), -(1 << 62) - 1, -(1 << 63), None]
    rows = [(i, corpus[5][1] + f" tail{k} " + corpus[k][1]) for k, i in enumerate(ids)]
    got = anchors.remove_repeats(frame(rows), ["doc_id"], **SMALL).select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, windows_removed(rows)))


def test_keep_one(frame, corpus, odd):
    docs = frame(corpus + [(r[0] if r[0] is None else r[0] - 1000, r[1]) for r in odd]).withColumn("gone_id", anchors.F.lit(3))
    kept = jaccard.keep_one(docs)
    want = {i for i, _, c in classes(corpus) if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id >= 0} == want
    assert jaccard.match(frame([])).count() == 0 and jaccard.keep_one(frame([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(7, 7)]
    root = {k: k for link in links for k in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: v for k, v in root.items() if k in got} and all(root[k] == k for k in root.keys() - got.keys())
