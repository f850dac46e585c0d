"""SentencePiece coding against the library, and the memory of the coders."""

import random
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece

from creditloom.llm import pieces
from creditloom.llm.common import Generations

PATH = public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "", " ", "a b", "  a  b ", "\n\n x\ty", "<s> </s> <unk> <0x41>", "▁a ▁", "a\x00b", "﻿a", "a" * 3000, "ab" * 4000,
    " " * 100 + "a" + " " * 37, "xyzzy" * 900, "▁" * 40, "lang " * 3000, "中文字符测试" * 50, "1234567", "it's 'll  \n\n x", "͸ ͸😀é",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(library):
    encode, decode = pieces.coder(PATH)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aab éß😀\n\t 12'sdrTH!!  ▁中文<>0x()[]{};:thеинго") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    for text in texts:
        ids = list(encode(text))
        assert ids == library.encode(text)
        assert decode(ids) == library.decode(ids)


def test_decodes_any_ids(library):
    _, decode = pieces.coder(PATH)
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3), 3 + rng.randrange(256)]) for _ in range(rng.randint(0, 12))]
        assert decode(ids) == library.decode(ids)


def test_backtracking_equals_merging():
    """Without the cut into segments: whole strings, from ambiguous letters, against plain merging."""
    coder = pieces.Coder(pieces.Model(PATH))
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice("▁▁aeinorst") for _ in range(rng.randint(1, 30)))
        assert [coder.texts[i] for i in coder.encode(text)] == coder.merged(text)


def test_segments_are_independent(library):
    """No piece spans a border of two segments."""
    model = pieces.Model(PATH)
    cut = model.segments()
    for text in model.ids:
        assert cut.findall(text) == [text]
    assert "".join(cut.findall("▁one▁two\n3▁▁4.")) == "▁one▁two\n3▁▁4."


def test_tables(spark, frame, odd, library):
    docs = frame(odd).withColumnRenamed("n_chars", "n_tokens")
    got = sorted(tuple(r) for r in pieces.digests(docs, PATH).fillna(-99).collect())
    want = []
    for row in odd:
        ids = library.encode(row[1] or "")
        want.append((-99 if row[0] is None else row[0], len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    encoded = pieces.encode_table(docs, PATH, carry=("doc_id", "source"))
    back = pieces.decode_table(encoded, PATH)
    assert sorted((str(r[0]), r[1]) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in odd)
    assert pieces.digests(frame([]), PATH).count() == 0


def test_memory_stays_bounded_and_right():
    made = []
    memory = Generations(lambda key: made.append(key) or key.encode(), 100_000)
    rng = random.Random(6)
    largest = 0
    for k in range(60_000):
        key = f"k{rng.randrange(30_000)}" if k % 3 else "frequent"
        assert memory.get()(key) == key.encode()
        largest = max(largest, len(memory.young) + len(memory.old))
    assert largest <= 100_000 // 160 and made.count("frequent") == 1
    stale = memory.get()
    for k in range(5000):
        assert stale(f"late{k}") == f"late{k}".encode()
    assert len(memory.young) + len(memory.old) <= 100_000 // 160


def test_memory_of_a_worker():
    """Half a million distinct words leave a worker's memory where it was."""
    import resource

    encode, _ = pieces.coder(PATH)
    rng = random.Random(7)

    def words(n):
        for _ in range(n):
            encode(" ".join("%x" % rng.getrandbits(40) for _ in range(2000)))

    words(100)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    words(150)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 * 1024
