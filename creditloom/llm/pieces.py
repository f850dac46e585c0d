"""SentencePiece encoding and decoding of merge-type models, by exact backtracking.

A merge-type model joins, again and again, the neighbours whose joint piece scores highest,
leftmost first. The same ids come from a search without a queue: at a position take the
longest piece that matches there (Aho-Corasick finds all matches of a segment at once); it may
follow the piece before it only if merging the two pieces' text from its characters gives back
exactly these two; if not, take the next shorter piece; if none is left, mark the position as
failed and go back one piece. A sequence whose neighbours are all compatible is the merge
result, so a position is reached in one way only, and one that failed once stays failed: a bit
per position is enough, and a segment of megabytes needs no more than a pass.

Texts are cut into segments first, at places that no piece of the vocabulary spans: before a
run of spaces, and between characters that no chain of pieces connects. Segments are encoded
on their own and remembered in about ``CACHE_BYTES`` a worker; what is forgotten is encoded
again. A character without a piece becomes the pieces of its UTF-8 bytes.

Encoding is one pass over the rows in Arrow batches, without a shuffle. Models with a
character map, trimming of spaces, spaces at word ends, user-defined or unused pieces,
without byte pieces, or with letters that are no pieces are refused, not approximated.

Edge cases: null and empty texts have no tokens and the digests of the empty string; repeated
rows get equal rows; an empty table gives no rows; other columns are not read. A text may be
of any length; its ids are held at once. U+2581 is the model's own sign for a space, so it
comes back as a space, as the library returns it.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Generations, map_texts

CACHE_BYTES = 64_000_000
PAIRS = 1 << 18

OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"

SPACE = "▁"


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


# Bytes that are no UTF-8 become one U+FFFD each, as the library decodes them.
codecs.register_error("creditloom-each-byte", _each_byte)


class Model:
    """Pieces, their scores and kinds, read from a model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind, trainer, normalizer = proto.ModelProto.SentencePiece, model.trainer_spec, model.normalizer_spec
        if trainer.model_type != proto.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type model with byte pieces and leading spaces")
        if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
            raise ValueError("the model normalizes its input")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("the model has user-defined or unused pieces")
        letters = {c for p in model.pieces if p.type == kind.NORMAL for c in p.piece}
        if not letters <= {p.piece for p in model.pieces if p.type == kind.NORMAL}:
            raise ValueError("the model joins characters that are no pieces")
        self.prefix = SPACE if normalizer.add_dummy_prefix else ""
        self.unknown = trainer.unk_surface
        self.texts = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.unknowns = {i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN}
        self.byte_ids = [0] * 256
        self.byte_of = {}
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value

    def segments(self) -> re.Pattern:
        """Matches the segments of a text, whose borders no piece spans.

        Characters are of one class if a chain of pieces has them side by side. A segment is a
        run of spaces and a run of one class after it; characters in no longer piece are
        segments of their own.
        """
        longer = [t for t in self.ids if len(t) > 1]
        if any(SPACE in t.lstrip(SPACE) for t in longer):
            return re.compile(r".+", re.S)
        parent: dict[str, str] = {}

        def root(c: str) -> str:
            parent.setdefault(c, c)
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for text in longer:
            text = text.lstrip(SPACE)
            for a, b in zip(text, text[1:] or text, strict=False):
                parent[root(a)] = root(b)
        classes = defaultdict(list)
        for c in parent:
            classes[root(c)].append(c)
        runs = ["".join(re.escape(c) for c in of) for of in sorted(classes.values(), key=len, reverse=True)]
        return re.compile("|".join([*(f"{SPACE}*[{run}]+" for run in runs), f"{SPACE}+", "."]), re.S)


class Coder:
    """Encodes segments by backtracking."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids, self.texts, self.scores = model.ids, model.texts, model.scores
        self.sizes = [len(t) for t in model.texts]
        self.automaton = ahocorasick.Automaton()
        for text, i in model.ids.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        # The longest shorter piece each piece starts with, -1 for none.
        self.shorter = [-1] * len(model.texts)
        for text, i in model.ids.items():
            for end in range(len(text) - 1, 0, -1):
                if text[:end] in model.ids:
                    self.shorter[i] = model.ids[text[:end]]
                    break
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives, best score first, leftmost among equals; for short texts."""
        parts, ids, scores = list(text), self.ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; -1 stands for the start."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.texts[left] if left >= 0 else "", self.texts[right]
            known = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.pairs) < PAIRS:
                self.pairs[key] = known
        return known

    def encode(self, segment: str) -> list[int]:
        """Ids of a segment."""
        n, sizes = len(segment), self.sizes
        longest = [-1] * n
        # Of the matches that start at one place, a longer one ends, and so comes, later.
        for end, piece in self.automaton.iter(segment):
            longest[end + 1 - sizes[piece]] = piece
        if -1 not in longest:
            return self.search(longest, 0, n)
        # A character without a piece of its own joins nothing: what is before it ends there.
        out: list[int] = []
        stop = 0
        while stop < n:
            start = stop
            while stop < n and longest[stop] >= 0:
                stop += 1
            out += self.search(longest, start, stop)
            while stop < n and longest[stop] < 0:
                out.extend(map(self.model.byte_ids.__getitem__, segment[stop].encode("utf-8", "surrogatepass")))
                stop += 1
        return out

    def search(self, longest: list[int], start: int, stop: int) -> list[int]:
        """Ids of the characters from start to stop, which all have pieces."""
        sizes, shorter, known, compatible = self.sizes, self.shorter, self.pairs.get, self.compatible
        failed = bytearray((stop - start >> 3) + 1)  # a bit per position
        path: list[int] = []
        at, before = start, -1
        piece = longest[at] if at < stop else -1
        while at < stop:
            while piece >= 0:
                end = at + sizes[piece]
                place = end - start
                if not failed[place >> 3] >> (place & 7) & 1:
                    fits = known(before << 32 | piece)
                    if compatible(before, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                at, before = end, piece
                if at < stop:
                    piece = longest[at]
            else:
                place = at - start
                failed[place >> 3] |= 1 << (place & 7)
                piece = path.pop()
                at -= sizes[piece]
                before = path[-1] if path else -1
        return path


@lru_cache(maxsize=1)
def coder(path: str, limit: int = CACHE_BYTES):
    """encode(text) -> ids, decode(ids) -> text. The tasks of a Python worker share one."""
    model = Model(path)
    segments, backtrack = model.segments(), Coder(model)

    def packed(segment: str) -> bytes:
        known = model.ids.get(segment)
        if known is not None and backtrack.compatible(-1, known):
            return array("i", [known]).tobytes()
        return array("i", backtrack.encode(segment)).tobytes()

    memory = Generations(packed, limit)
    cut = segments.findall

    def encode(text: str) -> array:
        ids = array("i")
        if text:
            ids.frombytes(b"".join(map(memory.get(), cut(model.prefix + text.replace(" ", SPACE)))))
        return ids

    surfaces = [("" if i in model.control else model.unknown if i in model.unknowns else t.replace(SPACE, " ")).encode() for i, t in enumerate(model.texts)]
    for i, value in model.byte_of.items():
        surfaces[i] = bytes([value])
    leading = {i for i, t in enumerate(model.texts) if t.startswith(SPACE) and model.prefix}

    ends = model.control | model.unknowns

    def decode(ids) -> str:
        if not ends.isdisjoint(ids):  # bytes on both sides of such a piece are no one character
            ends_at = [k for k, i in enumerate(ids) if i in ends]
            parts = [ids[a:b] for a, b in zip([0, *(k + 1 for k in ends_at)], [*ends_at, len(ids)], strict=True)]
            out = ""
            for k, part in enumerate(parts):
                out += decode_run(part, out == "")
                if k < len(ends_at):
                    out += surfaces[ids[ends_at[k]]].decode()
            return out
        return decode_run(ids, True)

    def decode_run(ids, first: bool) -> str:
        raw = b"".join(map(surfaces.__getitem__, ids))
        # The first piece loses the space that encoding put before it.
        if first and len(ids) and ids[0] in leading:
            raw = raw[1:]
        return raw.decode("utf-8", "creditloom-each-byte")

    return encode, decode


def encode_table(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens and the ids of every text."""

    def make():
        encode, _ = coder(path)

        def run(texts: list[str]):
            rows = [encode(text) for text in texts]
            sizes = [len(ids) for ids in rows]
            values = np.frombuffer(b"".join(ids.tobytes() for ids in rows), np.int32)
            return [sizes, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))]

        return run

    return map_texts(docs, make, "n_tokens long, ids array<int>", carry=carry, rows=256)


def decode_table(encoded: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the text of every row of ids."""

    def make():
        _, decode = coder(path)
        return lambda rows: [[decode(ids) for ids in rows]]

    return map_texts(encoded, make, "text string", carry=carry, texts=("ids",), rows=256)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens and the digests of the ids and of the decoded text of every text."""

    def make():
        encode, decode = coder(path)
        decimal = [str(i) for i in range(len(Model(path).texts))].__getitem__

        def row(text: str):
            ids = encode(text)
            return len(ids), sha256(",".join(map(decimal, ids)).encode()).hexdigest(), sha256(decode(ids).encode()).hexdigest()

        return lambda texts: list(zip(*map(row, texts), strict=True))

    return map_texts(docs, make, OUT, rows=256)
