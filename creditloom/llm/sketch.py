"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs: at line ends and at sentence ends. Those of ``LONG`` words or more
are cut further, after every word whose hash is less than both neighbours' (some three words
apiece), and words over ``LONG_WORD`` characters, as of scripts without spaces, after every
character whose hash is the least within ``REACH``. These places depend on the words around
them alone, so an edit changes the pieces near it and no others. Every digest of a piece, called
paragraph below, is added to three cells of a sketch; a cell holds a count, the sum of digests and the
sum of their check values, all modulo 2**64. Subtracting the sketches of two versions leaves
only the paragraphs in which they differ, and peeling cells that hold a single digest recovers
these one by one. Where peeling gets stuck, both sketches are built again at four times the size.
Likeness is the Jaccard index of the two multisets of paragraphs, from their sizes and the
number of digests recovered.

The fingerprint of a text is its sketch of ``CELLS`` cells. Each document is compared with its
edited text and with the next document in ascending doc_id. Documents move once, to buckets of
neighbouring ids; the last of a bucket gets the first of the next one by a join of one row per
bucket. Everything else runs in Arrow batches.

Edge cases: a null text counts as empty; an empty text has no paragraphs, and two such are
alike (1). Documents of one doc_id are ordered by text. Null ids come first. A single document
is its own next. An empty table gives no rows. Other columns are not read. A paragraph of fewer
than ``LONG`` words is one piece. A run of one word and a long word that repeats within ``REACH``
characters have no such place and are one piece in the fingerprints, ``near_edited`` and
``near_next``; ``runs_edited`` and ``runs_next`` are the same likenesses with runs cut every
``RUN`` words, and such words every ``LONG_WORD`` characters, from where they begin.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256
from itertools import pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

CELLS = 18
NEIGHBOURS = 256  # ids of a bucket
BUCKETS_TOGETHER = 4096

OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, runs_edited double, runs_next double"

LONG = 12  # words of a paragraph that is cut further
LONG_WORD = 24  # characters of a word that is not cut
RUN = 3
REACH = 3

_CUT = re.compile(r"\n|(?<=[.!?]) |(?<=[。！？｡])")
_WORD = re.compile(r"\s*\S+|\s+$")
_U = np.uint64
_SALTS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_parts(word: str, runs: bool) -> list[str]:
    """A long word, cut where a character pair hashes lower than all others within ``REACH``."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    hashes = _mix(codes[:-1] * _SALTS[0] + codes[1:] * _SALTS[1])
    padded = np.r_[np.full(REACH, ~_U(0)), hashes, np.full(REACH, _U(0))]  # no cut where the word ends within reach
    least = np.ones(len(hashes), bool)
    for k in range(2 * REACH + 1):
        if k != REACH:
            least &= hashes < padded[k : k + len(hashes)]
    cuts = [0, *(np.flatnonzero(least) + 1).tolist(), len(word)]
    parts = [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [p[k : k + LONG_WORD] for p in parts for k in range(0, len(p), LONG_WORD)] if runs else parts


def pieces(paragraph: str, runs: bool = False) -> list[str]:
    """A paragraph, cut further if it is long; the pieces together are the paragraph."""
    if len(paragraph) < 2 * LONG - 1:
        return [paragraph]
    words = _WORD.findall(paragraph)
    if len(words) < LONG and max(map(len, words)) <= LONG_WORD:
        return [paragraph]
    bare = list(map(str.strip, words))
    cuts: list[int] = []
    if len(words) >= LONG:
        # The word before the first counts as greater than any.
        hashes = [1 << 64, *map(xxhash.xxh3_64_intdigest, bare)]
        cuts = [k for k, (a, b, c) in enumerate(zip(hashes, hashes[1:], hashes[2:]), 1) if a > b < c]
        if runs:
            same, found = 0, set(cuts)
            for k, (a, b) in enumerate(pairwise(hashes)):
                same = same + 1 if a == b else 0
                if same and same % RUN == 0:
                    found.add(k)
            cuts = sorted(found)
    if max(map(len, bare)) <= LONG_WORD:
        return ["".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True)]
    out, ends = [""], set(cuts)
    for k, (word, plain) in enumerate(zip(words, bare, strict=True), 1):
        first, *rest = _word_parts(word, runs) if len(plain) > LONG_WORD else [word]
        out[-1] += first
        out += rest
        if k in ends:
            out.append("")
    return [p for p in out if p]


def digests(text: str, runs: bool = False, known: dict[str, list[int]] | None = None) -> np.ndarray:
    """One digest per piece that is not blank; repeats of a piece differ by their number.

    With ``runs``, what has no place to cut is cut every ``RUN`` words or ``LONG_WORD`` characters.
    ``known`` keeps the digests of paragraphs between calls with equal ``runs``.
    """
    known = {} if known is None else known
    parts: list[int] = []
    for p in _CUT.split(text):
        if p.strip():
            if p not in known:
                known[p] = list(map(xxhash.xxh3_64_intdigest, pieces(p, runs)))
            parts += known[p]
    plain = np.array(parts, _U)
    if len(plain) < 2:
        return plain
    plain.sort()
    fresh = np.flatnonzero(np.r_[True, plain[1:] != plain[:-1]])
    if len(fresh) == len(plain):
        return plain
    number = np.arange(len(plain)) - np.repeat(fresh, np.diff(np.r_[fresh, len(plain)]))
    return np.where(number > 0, _mix(plain + number.astype(_U) * _SALTS[0]), plain)


class Sketches:
    """The sketches of many texts at one size, row by row."""

    def __init__(self, sets: list[np.ndarray], cells: int) -> None:
        self.cells, self.n = cells, len(sets)
        keys = np.concatenate(sets) if sets else np.zeros(0, _U)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.count = np.zeros(self.n * cells, np.int64)
        self.total = np.zeros(self.n * cells, _U)
        self.check = np.zeros(self.n * cells, _U)
        self.add(owner, keys, np.ones(len(keys), np.int64))

    def places(self, owner: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        third = self.cells // 3
        return [owner * self.cells + part * third + (_mix(keys + salt) % _U(third)).astype(np.int64) for part, salt in enumerate(_SALTS)]

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        checks = _mix(keys ^ _SALTS[1])
        signed = sign.astype(_U)  # -1 wraps to 2**64 - 1
        for at in self.places(owner, keys):
            np.add.at(self.count, at, sign)
            np.add.at(self.total, at, keys * signed)
            np.add.at(self.check, at, checks * signed)

    def subtract(self, other: Sketches) -> None:
        self.count -= other.count
        self.total -= other.total
        self.check -= other.check

    def serialized(self) -> list[str]:
        """Cells one after another: count, sum of digests, upper half of the check."""
        cells = np.zeros((self.n, self.cells), np.dtype([("count", "<i4"), ("total", "<u8"), ("check", "<u4")]))
        cells["count"], cells["total"] = self.count.reshape(self.n, -1), self.total.reshape(self.n, -1)
        cells["check"] = (self.check >> _U(32)).reshape(self.n, -1)
        return [base64.b64encode(row.tobytes()).decode() for row in cells]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """owner, digest and sign of what is recovered, and which rows were emptied."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            single = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[single]
            keys = self.total[single] * sign.astype(_U)
            sure = self.check[single] == _mix(keys ^ _SALTS[1]) * sign.astype(_U)
            single, keys, sign = single[sure], keys[sure], sign[sure]
            if not len(single):
                break
            owner = single // self.cells
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            first = np.r_[True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]
            owner, keys, sign = owner[first], keys[first], sign[first]
            self.add(owner, keys, -sign)
            found.append((owner, keys, sign))
        left = (self.count != 0) | (self.total != 0) | (self.check != 0)
        empty = ~left.reshape(self.n, self.cells).any(axis=1) if self.n else np.zeros(0, bool)
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return columns[0], columns[1], columns[2], empty


def differing(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> list[np.ndarray]:
    """The digests only one of each pair has, by subtracting and peeling, larger on failure."""
    out: list[np.ndarray | None] = [None] * len(left)
    waiting = np.arange(len(left))
    while len(waiting):
        a = Sketches([left[i] for i in waiting], cells)
        a.subtract(Sketches([right[i] for i in waiting], cells))
        owner, keys, _, empty = a.peel()
        order = np.argsort(owner, kind="stable")
        owner, keys = owner[order], keys[order]
        cuts = np.searchsorted(owner, np.arange(len(waiting) + 1))
        for row in np.flatnonzero(empty):
            out[waiting[row]] = keys[cuts[row] : cuts[row + 1]]
        waiting = waiting[~empty]
        cells *= 4
        # At eight cells a digest only digests that share all their cells fail, and always would.
        for i in [i for i in waiting if cells > 16 * (len(left[i]) + len(right[i])) + 64]:
            out[i] = np.setxor1d(left[i], right[i])
        waiting = np.array([i for i in waiting if out[i] is None], np.int64)
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    """Jaccard index of the paragraphs of each pair."""
    out = []
    for a, b, apart in zip(left, right, differing(left, right), strict=True):
        both = len(a) + len(b)
        out.append((both - len(apart)) / (both + len(apart)) if both else 1.0)
    return out


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def may_run(text: str) -> bool:
    """Whether ``runs`` may cut a piece of the text."""
    words = text.split()
    return b"\1" * RUN in bytes(map(str.__eq__, words, words[1:])) or max(map(len, words), default=0) > LONG_WORD


def compare_rows(texts: list[str], following: list[str]) -> list[list]:
    """The columns of ``OUT``."""
    edited = [edited_text(t, f) for t, f in zip(texts, following, strict=True)]
    once: dict[str, np.ndarray] = {}
    known: dict[str, list[int]] = {}
    for t in (*texts, *edited, *following):
        if t not in once:
            once[t] = digests(t, known=known)
    own, new, others = ([once[t] for t in column] for column in (texts, edited, following))
    near = [likeness(own, new), likeness(own, others)]
    # Few texts hold a piece that only ``runs`` cuts.
    finer = {t: digests(t, runs=True) for t in once if may_run(t)}
    for right, values in ((edited, near[0]), (following, near[1])):
        at = [k for k, (t, r) in enumerate(zip(texts, right, strict=True)) if t in finer or r in finer]
        cut = likeness([finer.get(texts[k], once[texts[k]]) for k in at], [finer.get(right[k], once[right[k]]) for k in at])
        near.append([*map(dict(zip(at, cut, strict=True)).get, range(len(texts)), values)])
    return [
        [len(t) for t in texts],
        [sha256(t.encode()).hexdigest() for t in edited],
        Sketches(own, CELLS).serialized(),
        Sketches(new, CELLS).serialized(),
        *near,
    ]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by id; the last is followed by the first."""
    bucket = F.coalesce(F.floor(F.col("doc_id") / NEIGHBOURS), F.lit(-(1 << 56)))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.alias("bucket"))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    led = keyed.select("*", F.lead("text").over(inside).alias("led"), F.row_number().over(inside).alias("place"))
    firsts = led.where("place = 1").select("bucket", F.col("text").alias("first_text"))
    # The bucket after a bucket: among a few thousand by a window, beyond them by one row each.
    grouped = firsts.select("bucket", F.floor(F.col("bucket") / BUCKETS_TOGETHER).alias("group"))
    heads = grouped.groupBy("group").agg(F.min("bucket").alias("head"))
    across = Window.orderBy("group")
    heads = heads.select("group", F.coalesce(F.lead("head").over(across), F.first("head").over(across)).alias("next_head"))
    chained = grouped.select("bucket", "group", F.lead("bucket").over(Window.partitionBy("group").orderBy("bucket")).alias("after"))
    chained = chained.join(heads, "group").select("bucket", F.coalesce("after", "next_head").alias("after"))
    ends = chained.join(firsts.select(F.col("bucket").alias("after"), "first_text"), "after").select("bucket", "first_text")
    return led.join(ends, "bucket").select("doc_id", "text", F.coalesce("led", "first_text").alias("next_text"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of every document."""
    return map_texts(with_next(docs), lambda: compare_rows, OUT, texts=("text", "next_text"), rows=256)
