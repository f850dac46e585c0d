"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte pieces. Every mergeable neighbour pair waits in the
bucket of its rank, which holds list positions. A bitmap of two levels marks the filled
buckets, so the next rank is found by two find-first-set steps, and its leftmost position is
popped. Entries whose pair has changed since are skipped. Work per merge
does not depend on the pre-token's length, so a pre-token of megabytes is no special case.

Encoding is one pass over the rows in Arrow batches, without a shuffle. Each Python worker
remembers the ids of the pre-tokens it met, in about ``CACHE_BYTES``; what it forgets it
encodes again, so the bound changes no result.

Edge cases: null and empty texts have no tokens and the digests of the empty string; repeated
rows get equal rows; an empty table gives no rows; other columns are not read. Lone surrogates
can't occur in Spark strings.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Generations, map_texts

CACHE_BYTES = 160_000_000
#: The same for tables of ids: as a stage of a pipeline it shares its worker with other stages,
#: whose own memory the worker keeps.
TABLE_CACHE_BYTES = 32_000_000
PAIRS = 1 << 19

OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


NONE = 1 << 40  # above every rank
_BIT = [1 << i for i in range(256)]
_COUNT, _BACK = list(range(65)), list(range(-1, 64))


class Bpe:
    """Ranks of byte strings, and the pairs met so far."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.of_bytes = [ranks.get(bytes((a, b)), NONE) for a in range(256) for b in range(256)]

    @classmethod
    def load(cls, path: str) -> Bpe:
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks)

    def pair_rank(self, left: int, right: int) -> int:
        """Rank of the token two neighbours make, NONE for none."""
        rank = self.ranks.get(self.bytes[left] + self.bytes[right], NONE)
        if len(self.pairs) < PAIRS:
            self.pairs[left << 24 | right] = rank
        return rank

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        The queue: ``buckets`` holds list positions by rank. Bit ``rank % 256`` of
        ``low[rank // 256]`` marks a filled bucket, a bit of ``top`` a word that has bits. A
        pair waits in it only while no neighbour pair would be merged before it; the next
        merge is always such a pair, and a merge lets at most four others in.
        """
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        n = len(piece)
        pairs, bit, pair_rank = self.pairs, _BIT, self.pair_rank
        single = self.single
        ids = [single[b] for b in piece]
        after = _COUNT[1 : n + 1] if n < 64 else list(range(1, n + 1))
        before = _BACK[:n] if n < 64 else list(range(-1, n - 1))
        # By position: the rank of the pair that starts there, or NONE.
        of_bytes = self.of_bytes
        waiting = [of_bytes[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        waiting.append(NONE)
        entering = [i for i, (a, b, c) in enumerate(zip([NONE, *waiting], waiting, waiting[1:], strict=False)) if a > b <= c]
        buckets: dict[int, list[int]] = {}  # heaps of positions
        low: dict[int, int] = {}
        top = 0
        while True:
            for i in entering:
                rank = waiting[i]
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    if word in low:
                        low[word] |= bit[rank & 255]
                    else:
                        low[word] = bit[rank & 255]
                        top |= 1 << word
            if not top:
                break
            # Find-first-set on both levels gives the least rank, its heap the leftmost position.
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bits &= bits - 1
                if bits:
                    low[word] = bits
                else:
                    del low[word]
                    top &= top - 1
            entering = []
            if waiting[i] != rank:
                continue  # stale: the pair at i has changed since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], waiting[j] = rank, -1, NONE
            h = before[i]
            at_k = at_h = NONE
            if k < n:
                before[k] = i
                found = pairs.get(rank << 24 | ids[k])
                at_i = waiting[i] = pair_rank(rank, ids[k]) if found is None else found
                at_k = waiting[k]
                if at_k < at_i and at_k <= waiting[after[k]] if after[k] < n else at_k < at_i:
                    entering.append(k)
            else:
                at_i = waiting[i] = NONE
            if h >= 0:
                found = pairs.get(ids[h] << 24 | rank)
                at_h = waiting[h] = pair_rank(ids[h], rank) if found is None else found
                g = before[h]
                if g >= 0:
                    at_g = waiting[g]
                    if at_h < at_g:
                        if at_h <= at_i and at_h < NONE:
                            entering.append(h)
                    elif at_g < NONE and (before[g] < 0 or at_g < waiting[before[g]]):
                        entering.append(g)
                elif at_h <= at_i and at_h < NONE:
                    entering.append(h)
            if at_i < at_h and at_i <= at_k:
                entering.append(i)
        return [t for t in ids if t >= 0]


def by_rank(values: dict) -> list:
    """A list indexed by rank; ranks not in use hold None."""
    return [values.get(rank) for rank in range(max(values) + 1)]


@lru_cache(maxsize=1)
def coder(path: str, pattern: str, limit: int = CACHE_BYTES):
    """encode(text) -> ids, decode(ids) -> bytes. The tasks of a Python worker share one."""
    bpe = Bpe.load(path)
    memory = Generations(lambda piece: array("i", bpe.encode_piece(piece.encode())).tobytes(), limit)
    pieces, vocabulary = regex.compile(pattern), by_rank(bpe.bytes)

    def encode(text: str) -> array:
        ids = array("i")
        ids.frombytes(b"".join(map(memory.get(), pieces.findall(text))))
        return ids

    def decode(ids) -> bytes:
        return b"".join(map(vocabulary.__getitem__, ids))

    return encode, decode


def encode_table(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",), remembered: int = TABLE_CACHE_BYTES) -> DataFrame:
    """The carried columns, n_tokens and the ids of every text; a worker remembers ``remembered`` bytes of pre-tokens."""

    def make():
        encode, _ = coder(path, pattern, remembered)

        def run(texts: list[str]):
            rows = [encode(text) for text in texts]
            sizes = [len(ids) for ids in rows]
            values = np.frombuffer(b"".join(ids.tobytes() for ids in rows), np.int32)
            return [sizes, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))]

        return run

    return map_texts(docs, make, "n_tokens long, ids array<int>", carry=carry, rows=256)


def decode_table(encoded: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the text of every row of ids; bytes that are no UTF-8 become U+FFFD."""

    def make():
        vocabulary = Bpe.load(path).bytes

        def run(rows):
            return [[b"".join(map(vocabulary.__getitem__, ids)).decode("utf-8", "replace") for ids in rows]]

        return run

    return map_texts(encoded, make, "text string", carry=carry, texts=("ids",), rows=256)


def digests(docs: DataFrame, path: str, pattern: str, remembered: int = CACHE_BYTES) -> DataFrame:
    """n_tokens and the digests of the ids and of the decoded bytes of every text."""

    def make():
        encode, decode = coder(path, pattern, remembered)
        decimal = by_rank({rank: str(rank) for rank in Bpe.load(path).bytes}).__getitem__

        def row(text: str):
            ids = encode(text)
            return len(ids), sha256(",".join(map(decimal, ids)).encode()).hexdigest(), sha256(decode(ids)).hexdigest()

        return lambda texts: list(zip(*map(row, texts), strict=True))

    return map_texts(docs, make, OUT, rows=256)
