"""Substring deduplication by hashed windows at the places of a difference cover.

Bytes covered by a string of ``LENGTH`` bytes that also starts anywhere else are removed. In a
suffix array these are the suffixes that tie with a neighbour for ``LENGTH`` bytes. No suffix
array is built: suffixes are neither compared nor ordered, as removal needs only to know which
windows of ``LENGTH`` bytes are equal, and hashed buckets stay even where many suffixes begin alike.

- Samples start where the byte's number in its text, modulo ``PERIOD``, lies in a difference
  cover. Any two positions reach the cover together within ``PERIOD - 1`` bytes, so a tie of
  ``LENGTH`` bytes always holds a pair of samples that are equal for ``SAMPLE`` bytes. Hashes of
  these windows (called ranks in the code) are looked up first; one that only one sample has
  ends every tie that would run through it.
- Positions whose next samples all have hashes of their own can't be in a long tie and are left
  out. For the others, hashes of their ``LENGTH`` bytes are looked up; equal ones are ties.

Both lookups go through ``blocks``: every key is sent once per block and answered with one bit.
Whole copies of a text are found by digest on the way; only one copy's suffixes are sorted.
Ranks are a filter (40 bits and the bucket); a tie is 64 bits and the independent bucket.

Edge cases: a null text counts as empty; texts shorter than ``LENGTH`` keep all; matches never
cross documents; repeated rows tie with each other and lose everything; an empty table gives
no rows. Kept bytes may no longer be UTF-8, so they are binary. Other columns are carried by
``remove_ties`` and may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ANSWERS, BLOCK_BYTES, BUCKET_KEYS, KEYS, U, Distinct, Rolling, Texts, answer, byte_values, keys_table, lay_out, mix, size_of

LENGTH = 400
PERIOD = 133
#: Every number below 133 is a difference of exactly one pair of these, modulo 133.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SAMPLE = LENGTH - PERIOD + 1
RANK_BYTES = 5
#: Answers are told apart by their buckets: ranks, suffixes, whole texts (copies, then firsts).
SUFFIXES, COPIES, FIRSTS = 1 << 40, 2 << 40, 3 << 40


def cover_is_complete() -> bool:
    return {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


class Suffixes:
    """Sample ranks, whole texts and long suffixes of one block."""

    def __init__(self, block: pa.Table, buckets: int) -> None:
        self.texts, self.buckets = Texts(block), buckets
        self.rolling = Rolling(byte_values(self.texts.bytes))
        n = len(self.texts.bytes)
        self.doc = np.repeat(np.arange(len(self.texts.raw)), self.texts.lengths + 1)
        self.place = np.arange(n) - self.texts.starts[self.doc]
        self.left = self.texts.lengths[self.doc] - self.place
        self.at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= SAMPLE))
        hashes = self.rolling.spans(self.at, self.at + SAMPLE)
        self.samples = Distinct(hashes >> U(64 - 8 * RANK_BYTES), self._bucket(hashes))
        whole = np.array([xxhash.xxh3_64_intdigest(raw) for raw in self.texts.raw], U)
        self.whole = Distinct(whole, self._bucket(np.array([xxhash.xxh3_64_intdigest(raw, 1) for raw in self.texts.raw], U)))

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes ^ U(0x5851F42D4C957F2D)) % U(self.buckets)).astype(np.int64)

    def judge(self, answers: dict[int, bytes]) -> None:
        """Take the answers on ranks and whole texts, and list the suffixes to be sorted."""
        tied = self.at[self.samples.answered(answers)[self.samples.of]]
        self.copied = self.whole.answered(answers, COPIES)[self.whole.of]
        # One copy of a text stands for all: the first of its block, if no earlier block has it.
        lead = np.zeros(len(self.texts.raw), bool)
        lead[self.whole.order[self.whole.first]] = True
        lead &= ~self.whole.answered(answers, FIRSTS)[self.whole.of]
        reach = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(reach, np.maximum(tied - PERIOD + 1, self.texts.starts[self.doc[tied]]), 1)
        np.add.at(reach, tied + 1, -1)
        self.starts = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & (self.left >= LENGTH) & lead[self.doc])
        second = Rolling(byte_values(self.texts.bytes, 1)).spans(self.starts, self.starts + LENGTH) if len(self.starts) else np.zeros(0, U)
        self.sorted = Distinct(self.rolling.spans(self.starts, self.starts + LENGTH), (second % U(self.buckets)).astype(np.int64))

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes go."""
        ties = self.starts[self.sorted.answered(answers, SUFFIXES)[self.sorted.of]]
        cover = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(cover, ties, 1)
        np.add.at(cover, ties + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        gone |= (self.copied & (self.texts.lengths >= LENGTH))[self.doc]
        return gone & (self.left > 0)


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True))


def remove_ties(docs: DataFrame, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The carried columns as ``row``, n_bytes, n_removed, n_spans and kept of every document."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "text"]
    n_bytes = size_of(docs)
    laid = lay_out(docs, n_bytes, carry, block_bytes)
    buckets = max(1, n_bytes * len(COVER) // (PERIOD * bucket_keys))

    def send_samples(block: pa.Table) -> pa.Table:
        number = block.column("block")[0].as_py()
        suffixes = Suffixes(block, buckets)
        whole, samples = suffixes.whole, suffixes.samples
        owners = np.full(len(whole.keys), number)
        return keys_table(
            samples.sent(number, samples.counts > 1, width=RANK_BYTES)
            + whole.sent(number, whole.counts > 1, offset=COPIES)
            + whole.sent(number, whole.counts > 1, owners=owners, offset=FIRSTS)
        )

    def send_suffixes(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return keys_table([])
        suffixes = Suffixes(block, buckets)
        suffixes.judge(_answers(answers))
        keys = suffixes.sorted
        # Suffixes of a text that has copies tie with those, which are not sent.
        many = (keys.counts > 1) | keys.any(suffixes.copied[suffixes.doc[suffixes.starts]])
        return keys_table(keys.sent(block.column("block")[0].as_py(), many, offset=SUFFIXES))

    def cut(block: pa.Table, answers: pa.Table) -> pa.Table:
        suffixes = Suffixes(block, buckets)
        told = _answers(answers)
        suffixes.judge(told)
        gone = suffixes.removed(told)
        texts = suffixes.texts
        runs = np.flatnonzero(gone & ~np.r_[False, gone[:-1]])
        kept = []
        for start, length in zip(texts.starts.tolist(), texts.lengths.tolist(), strict=True):
            span = slice(start, start + length)
            kept.append(texts.bytes[span][~gone[span]].tobytes())
        count = lambda at: pa.array(np.bincount(suffixes.doc[at], minlength=len(texts.raw)))
        return pa.table({"row": texts.row(block), "n_bytes": pa.array(texts.lengths), "n_removed": count(gone), "n_spans": count(runs), "kept": pa.array(kept, pa.binary())})

    def by_block(df: DataFrame):
        return df.groupBy("block")

    def answer_samples(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        return answer(RANK_BYTES if bucket < SUFFIXES else 8, lambda b: b >= FIRSTS)(table)

    sent = by_block(laid).applyInArrow(send_samples, KEYS)
    ranks = sent.groupBy("bucket").applyInArrow(answer_samples, ANSWERS)
    sorted_ = by_block(laid).cogroup(by_block(ranks)).applyInArrow(send_suffixes, KEYS)
    ties = sorted_.groupBy("bucket").applyInArrow(answer(8, lambda b: False), ANSWERS)
    schema = T.StructType([laid.schema["row"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])
    return by_block(laid).cogroup(by_block(ranks.unionByName(ties))).applyInArrow(cut, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_ties(docs, ["doc_id"]).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
