"""Operators that work document by document, against plain versions and libraries."""

import random
import re
from collections import Counter
from hashlib import sha256

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from creditloom.llm import bpe, compression, langid, licenses, mixing, sketch, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(library):
    encode, decode = bpe.coder(PATH, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["", "a" * 3000, "ab" * 4000 + "c", "xyzzy" * 900, "<|endoftext|>", "it's 'll  \n\n x"]
    texts += ["".join(rng.choice("aab éß😀\n\t 12'sdrTH!!  ") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for text in texts:
        ids = list(encode(text))
        assert ids == library.encode_ordinary(text)
        assert decode(ids) == text.encode()


def test_bpe_forgets_and_stays_right(library):
    encode, _ = bpe.coder(PATH, public_tokenizers.PATTERN, limit=4000)
    for k in range(400):
        text = f"some{k % 37} words{k} again some{k % 5}"
        assert list(encode(text)) == library.encode_ordinary(text)


def test_bpe_tables(spark, frame, odd, library):
    docs = frame(odd)
    got = sorted(tuple(r) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).fillna(-99).collect())
    want = []
    for row in odd:
        text = row[1] or ""
        ids = library.encode_ordinary(text)
        want.append((-99 if row[0] is None else row[0], len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode_table(docs, PATH, public_tokenizers.PATTERN, carry=("doc_id", "source"))
    back = bpe.decode_table(encoded, PATH)
    assert sorted((str(r[0]), r[1]) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in odd)
    assert bpe.digests(frame([]), PATH, public_tokenizers.PATTERN).count() == 0


def paragraphs(text):
    return Counter(p for p in re.split(r"\n|(?<=[.!?]) ", text) if p.strip())


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints(frame, odd):
    rows = odd + [(k, "\n".join(f"line {random.Random(k).randrange(9)} of {j % 7}." for j in range(k))) for k in range(20, 340, 9)]
    rows = [r if len(r) == 5 else (*r, "en", "s", 0) for r in rows]
    got = {}
    for r in sketch.fingerprint(frame(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    by_text = {}
    for this, following in zip(order, order[1:] + order[:1], strict=True):
        text, after = this[1] or "", following[1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        fits = [r for r in got[this[0]] if r.n_chars == len(text) and r.edited_sha256 == sha256(edited.encode()).hexdigest()]
        assert fits, this[0]
        assert any(abs(r.near_edited - jaccard(text, edited)) < 1e-9 and abs(r.near_next - jaccard(text, after)) < 1e-9 for r in fits)
        assert by_text.setdefault(text, fits[0].fingerprint) == fits[0].fingerprint
    assert sum(map(len, got.values())) == len(rows)
    assert sketch.fingerprint(frame([])).count() == 0


def test_fingerprints_of_texts_without_marks():
    """Half of each text is kept, so its edited text shares pieces; an unrelated text shares none."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(7)) for _ in range(5000)]
    words = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (16, 40, 400, 3000)]
    signs = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n)) for n in (60, 300, 9000)]
    stops = ["".join(x + "。" * (k % 9 == 8) for k, x in enumerate(signs[1]))]
    codes = ["".join(rng.choice("ABCDEFGHIJabcdefghij0123456789+/") for _ in range(n)) for n in (80, 18_000)]
    tables = ["\t".join(str(rng.randrange(10**6)) for _ in range(200)), " | ".join(rng.choice(vocabulary) for _ in range(90))]
    for text in [*words, *map(str.upper, words), *signs, *stops, *codes, *tables]:
        after = " ".join("".join(rng.choice("pqrstuvwxyz") for _ in range(6)) for _ in range(len(text) // 7 + 1))
        _, _, _, _, (near,), (other,), (runs,), (runs_other,) = sketch.compare_rows([text], [after])
        assert 0 < near < 0.7 and other == 0 and 0 < runs < 0.7 and runs_other == 0, text[:40]
        if len(text) > 1000:
            assert near > 0.25
        assert "".join(sketch.pieces(text)) == "".join(sketch.pieces(text, True)) == text
    for text in ("lang " * 3000, "x\t" * 24, "=" * 4000, "字" * 60, "ab" * 300, "so it goes " + "on " * 90):
        found = sketch.compare_rows([text], ["pqr stuv " * (len(text) // 8)])
        assert 0.1 < found[6][0] < 0.7 and found[7] == [0], text[:40]


def test_peeling_recovers_what_differs():
    rng = np.random.default_rng(5)
    left, right = [], []
    for size in (0, 1, 5, 40, 300, 2000):
        common = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        left.append(np.concatenate([common, rng.integers(1, 1 << 63, size // 3, dtype=np.uint64)]))
        right.append(np.concatenate([common, rng.integers(1, 1 << 63, size // 5, dtype=np.uint64)]))
    for a, b, found in zip(left, right, sketch.differing(left, right), strict=True):
        assert sorted(found.tolist()) == sorted(np.setxor1d(a, b).tolist())


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, frame, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in compression.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(rows[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert compression.judge(frame(odd)).count() == len(odd)
    assert compression.judge(frame([])).count() == 0
    rng = random.Random(1)
    prose = " ".join(rng.choice(["the", "river", "runs", "and", "slowly", "towards", "old"]) + str(rng.randrange(300)) for _ in range(900))
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) + " " * (k % 3 == 0) for k in range(4000))
    packer = compression.zstandard.ZstdCompressor(level=compression.LEVEL)
    same = "".join(f"all work number {k % 9} and no play today. " for k in range(400))
    assert not compression.outside(compression.compression(prose.encode(), packer)[0], len(prose.encode()))
    assert compression.outside(compression.compression(same.encode(), packer)[0], len(same))
    assert compression.outside(compression.compression(noise.encode(), packer)[0], len(noise.encode())) or compression.compression(noise.encode(), packer)[0] < 1.7


def test_language(spark, frame, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held) > 100
    model = langid.train(docs)
    found = {(r.doc_id, r.lang_pred) for r in langid.identify(frame(odd), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= found
    assert {r.lang_pred for r in langid.identify(frame([(1, "words but nothing to learn from", None, "s", 0)])).collect()} == {"und"}
    assert langid.identify(frame([])).count() == 0


def test_language_learns_every_language(frame):
    """The 70 languages differ in their alphabets; the rarest have a few documents only."""
    rng, rows = random.Random(6), []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        for _ in range(30 if k < 35 else 12):
            text = " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(12))
            rows.append((len(rows), text, f"l{k:02}", "s", 0))
    truth = {r[0]: r[2] for r in rows}
    got = langid.identify(frame(rows)).collect()
    assert {r.lang_pred for r in got} == set(truth.values())
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.99 * len(rows)


def test_toxicity(spark, frame, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.train(docs, labels)
    held = [r for r in toxicity.score(docs, labels, model).collect() if r.held_out and r.doc_id in truth]
    caught = [r for r in held if truth[r.doc_id] == 1 and r.predicted]
    assert len(caught) >= 0.8 * sum(truth[r.doc_id] == 1 for r in held)
    assert sum(r.predicted for r in held if truth[r.doc_id] == 0) <= 0.01 * len(held)
    scored = toxicity.score(frame(odd), labels, model).collect()
    assert len(scored) == len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    kept = toxicity.drop_toxic(frame([*odd, (99, "you stupid idiot, worthless scum, pathetic moron", "en", "s", 1)]), labels, model)
    assert kept.columns == docs.columns and kept.count() == len(odd)
    none = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.score(frame(odd), none).collect())


def test_label_model_weighs_voters():
    rng = np.random.default_rng(2)
    y = (rng.random(3000) < 0.3).astype(int)
    votes = np.stack([np.where(rng.random(3000) < p, y, 1 - y) for p in (0.9, 0.85, 0.55)] + [np.zeros(3000, int)] * 2, axis=1)
    votes[:, 3] = votes[:, 4] = votes[:, 2]  # three voters that say the same
    known = np.where(rng.random(3000) < 0.3, y, -1)
    model = toxicity.LabelModel.fit(votes, known, 0.3)
    right = ((model.posterior(votes) >= 0.5) == y).mean()
    assert right > 0.88
    assert model.weights[2] < 0.5 < model.weights[0]


def water_fill(sizes, weights, cap=3):
    total, left, targets = sum(sizes), set(range(len(sizes))), {}
    while left:
        level = (total - sum(targets.values())) / sum(weights[k] for k in left)
        above = {k for k in left if level * weights[k] > cap * sizes[k]}
        if not above:
            return targets | {k: level * weights[k] for k in left}
        targets |= {k: cap * sizes[k] for k in above}
        left -= above
    return targets


def test_mixing(spark, frame, odd):
    rng = random.Random(4)
    shares = {"a": 900, "b": 40, "c": 5, "Z": 300, "é": 60, None: 30, "empty": 3}
    rows = [(k, "" if s == "empty" else "x " * rng.randrange(1, 60), "en", s, 0) for k, s in enumerate(s for s, n in shares.items() for _ in range(n))]
    got = mixing.mix(frame(rows)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    targets = water_fill([sizes[n] for n in names], [k % 3 + 1 for k in range(len(names))])
    want = {n: targets[k] for k, n in enumerate(names)}
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.size == 0 or (r.taken % r.size == 0 and 0 <= r.taken <= 3 * r.size)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[n] - want[n]) <= 0.25 * want[n] + 60 for n in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(rows)).collect()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(rows), broadcast_sources=0).collect()))
    emitted = Counter(r.doc_id for r in mixing.emit(frame(rows)).select("doc_id").collect())
    assert all(emitted[r.doc_id] * r.size == r.taken for r in got)
    clash = frame(odd).withColumn("target", mixing.F.lit(1)).withColumn("mix_source", mixing.F.lit("q")).withColumn("row", mixing.F.lit(2))
    assert mixing.emit(clash).columns == clash.columns
    assert mixing.mix(frame(odd)).count() == len(odd) and mixing.mix(frame([])).count() == 0


def test_licenses(frame, odd):
    mit = dict(licenses.KNOWN)["BSD-2-Clause"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper()),
        (2, mit.replace("copyright holder", "copyright owner").replace(",", " , ")),
        (3, mit + " and more"),
        (4, "prose\nRELEASED under the M.I.T. licence\nreleased under the mit  licence!\nLicensed under CC BY-NC 4.0."),
        (5, "not licensed"),
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(rows)).collect()}
    assert got[1].license_id == got[2].license_id == "BSD-2-Clause" and got[1].text_digest == got[2].text_digest
    assert got[3].license_id is None and got[5].n_notices == 0
    assert (got[4].n_notices, got[4].notices) == (2, "CC-BY-NC-4.0,MIT")
    commented = "\n".join(f"# {line}" for line in ("Copyright 2020 X", *mit.split("\n")))
    slashes = "\n".join(f"// {line}" for line in ("(c) Some Body, 2019", "All rights reserved.", *mit.split("\n")))
    assert {r.license_id for r in licenses.scan(frame([(1, commented), (2, slashes)])).collect()} == {"BSD-2-Clause"}
    odd_rows = licenses.scan(frame(odd)).collect()
    assert len(odd_rows) == len(odd) and all(r.license_id is None for r in odd_rows)
    assert {r.text_digest for r in odd_rows if r.doc_id == 1} == {None}
    plan = licenses.scan(frame(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan(frame([])).count() == 0


def test_licenses_of_a_table(spark, frame):
    texts = spark.createDataFrame([("Own-1.0", "You may use this.\nYou may not sell it."), ("Own-1.0-alias", "you may use this - you may not sell it"), ("Empty", " "), ("Null", None), ("Line", "Use it freely.")], "license_id string, text string")
    rows = [(1, "YOU MAY USE THIS!\n\nYou may not sell it"), (2, "a\nuse it, freely\nb"), (3, dict(licenses.KNOWN)["MIT"]), (4, "")]
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(frame(rows), texts).collect()}
    assert got == {1: ("Own-1.0", ""), 2: (None, "Line"), 3: (None, ""), 4: (None, "")}
    assert [r.license_id for r in licenses.scan(frame(rows), texts.limit(0)).collect()] == [None] * 4
