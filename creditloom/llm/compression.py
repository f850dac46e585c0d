"""Quality rules by compression bands.

Repetitive text compresses far better than prose, and random text hardly at all. A document
is judged by its zstandard ratio (bytes over compressed bytes) as a whole and in fixed
chunks of its bytes. Short texts compress worse than long ones, so every length has limits
of its own (``BANDS``). A document is kept if its whole ratio lies inside its band and no
more than ``BAD_SHARE`` of its chunks lie outside the band of a chunk's length. Texts below
the shortest band pass this rule.

The work is one pass over the rows in Arrow batches, without a shuffle; memory is one batch
of rows and one text's words.

Edge cases: null and empty texts have no words and fail the base rules; repeated rows get
equal rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import map_texts

SYMBOLS = "#*$%&|<>"
CHUNK = 4096
LEVEL = 3
#: (from so many bytes, least ratio, greatest ratio): the band of texts of that length.
BANDS = [
    (256, 1.1, 2.2),
    (512, 1.2, 2.5),
    (1024, 1.3, 2.8),
    (2048, 1.4, 3.0),
    (4096, 1.5, 3.3),
    (16384, 1.6, 3.8),
    (65536, 1.6, 4.5),
]
BAD_SHARE = 0.34

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def band(n_bytes: int) -> tuple[float, float] | None:
    found = None
    for start, low, high in BANDS:
        if n_bytes >= start:
            found = (low, high)
    return found


def outside(ratio: float, n_bytes: int) -> bool:
    limits = band(n_bytes)
    return limits is not None and not limits[0] <= ratio <= limits[1]


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(codes) + ids[1:]
    # Windows by pair number and third word, so that products stay in 64 bits.
    _, pair = np.unique(pairs, return_inverse=True)
    windows = pair[:-1] * len(codes) + ids[2:]
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = times[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= starts
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    return len(words), len(text) - spaces, sum(raw.count(c.encode()) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def compression(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """Whole ratio, chunks, chunks outside their band. The ratio of no bytes is 0."""
    if not raw:
        return 0.0, 0, 0
    ratio = len(raw) / len(packer.compress(raw))
    if len(raw) <= CHUNK:
        return ratio, 1, int(outside(ratio, len(raw)))
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    return ratio, len(chunks), sum(outside(len(c) / len(packer.compress(c)), len(c)) for c in chunks)


def verdict(text: str, packer: zstandard.ZstdCompressor) -> tuple:
    n_words, word_chars, n_symbols, n_dup, n_repeat = base_counts(text)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    raw = text.encode()
    ratio, chunks, bad = compression(raw, packer)
    kept = not failed and not outside(ratio, len(raw)) and bad <= BAD_SHARE * chunks
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, kept, ratio, chunks, bad


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, ratio, chunk counts and verdict of every document."""

    def make():
        packer = zstandard.ZstdCompressor(level=LEVEL)
        return lambda texts: list(zip(*(verdict(text, packer) for text in texts), strict=True))

    return map_texts(docs, make, OUT)
