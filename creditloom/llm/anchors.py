"""Substring deduplication on difference-cover anchors.

A window of ``WINDOW`` words is removed where an equal one starts in a document with a smaller
doc_id. Positions whose number modulo ``PERIOD`` lies in the difference cover {0, 1, 3} are
anchors. Any two positions reach the cover together within ``PERIOD - 1`` steps, so two equal
windows always share an anchor at the same place inside them, followed by at least
``ANCHOR`` = 7 equal words. Only these 7-word spans are hashed and looked up over the whole
corpus; where an anchor is met in more than one place, the matches around it extend to the
whole windows, which are then compared by keys of their own with the smallest doc_id that
holds them.

Both lookups go through ``blocks``: every key is sent once per block, in buckets of bounded
size. Texts move once, to their blocks. Anchors are only a filter (40 bits and the bucket);
windows are equal if 64 bits and the independent bucket are.

Edge cases: a null text has no words; texts shorter than a window keep all their words (white
space between them becomes one space); rows of one doc_id don't remove each other's windows;
rows without doc_id neither lose nor remove any; an empty table gives no rows. Other columns
are carried by ``remove_repeats`` and may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ANSWERS, BLOCK_BYTES, BUCKET_KEYS, KEYS, U, Distinct, Rolling, Texts, answer, byte_values, keys_table, lay_out, mix, size_of

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
ANCHOR_BYTES = 5
#: Answers to windows are told from answers to anchors by this offset of their buckets.
WINDOWS = 1 << 40

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of a block: where they are, whose they are, and hashes of spans of them."""

    def __init__(self, texts: Texts) -> None:
        edges = np.diff(np.r_[True, _SPACE[texts.bytes], True].astype(np.int8))
        self.begin, self.end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        self.doc = np.searchsorted(texts.starts, self.begin, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts.raw))
        first = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.begin)) - first[self.doc] if len(self.begin) else np.zeros(0, np.int64)
        self.left = self.counts[self.doc] - self.place
        self.first = first
        self.texts = texts

    def rolling(self, table: int) -> Rolling:
        letters = Rolling(byte_values(self.texts.bytes, table))
        return Rolling(letters.spans(self.begin, self.end) | U(1))


def _anchors(words: Words, rolling: Rolling, buckets: int) -> tuple[np.ndarray, Distinct]:
    at = np.flatnonzero(np.isin(words.place % PERIOD, COVER) & (words.left >= ANCHOR))
    hashes = rolling.spans(at, at + ANCHOR)
    return at, Distinct(hashes >> U(64 - 8 * ANCHOR_BYTES), (mix(hashes ^ U(0x5851F42D4C957F2D)) % U(buckets)).astype(np.int64))


def _windows(words: Words, rolling: Rolling, at: np.ndarray, live: np.ndarray, given: np.ndarray, buckets: int) -> tuple[np.ndarray, Distinct]:
    """Windows that hold a live anchor within their first ``PERIOD`` words."""
    reach = np.zeros(len(words.begin) + 1, np.int64)
    hit = at[live]
    np.add.at(reach, np.maximum(hit - PERIOD + 1, words.first[words.doc[hit]]), 1)
    np.add.at(reach, hit + 1, -1)
    starts = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & (words.left >= WINDOW))
    starts = starts[given[words.doc[starts]]] if len(starts) else starts
    second = words.rolling(1).spans(starts, starts + WINDOW) if len(starts) else np.zeros(0, U)
    return starts, Distinct(rolling.spans(starts, starts + WINDOW), (second % U(buckets)).astype(np.int64))


def _owners(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, and which of them are given (null counts as 0 in the first)."""
    return np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool)


def _answers(table: pa.Table, offset: int) -> dict[int, bytes]:
    pairs = zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True)
    return {bucket: bits for bucket, bits in pairs if (bucket >= WINDOWS) == (offset > 0)}


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, keep_untouched: bool = False, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The carried columns as ``row``, n_words, n_removed and kept_text of every document.

    Kept words are joined by one space; with ``keep_untouched`` a document that loses no word
    keeps its text to the letter.
    """
    carry = docs.columns if carry is None else carry
    carry = [c for c in carry if c != "text"]
    n_bytes = size_of(docs)
    laid = lay_out(docs, n_bytes, carry, block_bytes)
    # A word takes some six bytes; three anchors in seven words.
    buckets = max(1, n_bytes * 3 // (7 * 6 * bucket_keys))

    def send_anchors(block: pa.Table) -> pa.Table:
        words = Words(Texts(block))
        _, distinct = _anchors(words, words.rolling(0), buckets)
        return keys_table(distinct.sent(block.column("block")[0].as_py(), distinct.counts > 1, width=ANCHOR_BYTES))

    def send_windows(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return keys_table([])
        texts = Texts(block)
        words, (owners, given) = Words(texts), _owners(texts.ids)
        rolling = words.rolling(0)
        at, anchors = _anchors(words, rolling, buckets)
        starts, windows = _windows(words, rolling, at, anchors.answered(_answers(answers, 0))[anchors.of], given, buckets)
        least = windows.least(owners[words.doc[starts]])
        return keys_table(windows.sent(block.column("block")[0].as_py(), windows.counts > 1, owners=least, offset=WINDOWS))

    def cut(block: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts(block)
        words, (owners, given) = Words(texts), _owners(texts.ids)
        rolling = words.rolling(0)
        at, anchors = _anchors(words, rolling, buckets)
        starts, windows = _windows(words, rolling, at, anchors.answered(_answers(answers, 0))[anchors.of], given, buckets)
        own = owners[words.doc[starts]]
        gone = windows.answered(_answers(answers, WINDOWS), WINDOWS)[windows.of] | (own > windows.least(own)[windows.of])
        cover = np.zeros(len(words.begin) + 1, np.int64)
        np.add.at(cover, starts[gone], 1)
        np.add.at(cover, starts[gone] + WINDOW, -1)
        removed = np.cumsum(cover[:-1]) > 0
        lost = np.bincount(words.doc[removed], minlength=len(texts.raw))
        kept = []
        for d, raw in enumerate(texts.raw):
            if lost[d]:
                span = slice(words.first[d], words.first[d] + words.counts[d])
                keep, base = ~removed[span], texts.starts[d]
                pairs = zip((words.begin[span][keep] - base).tolist(), (words.end[span][keep] - base).tolist(), strict=True)
                kept.append(b" ".join(raw[a:b] for a, b in pairs).decode())
            else:
                kept.append((raw if keep_untouched else b" ".join(raw.split())).decode())
        return pa.table({"row": texts.row(block), "n_words": pa.array(words.counts), "n_removed": pa.array(lost), "kept_text": pa.array(kept, pa.string())})

    def by_block(df: DataFrame):
        return df.groupBy("block")

    sent = by_block(laid).applyInArrow(send_anchors, KEYS)
    live = sent.groupBy("bucket").applyInArrow(answer(ANCHOR_BYTES, lambda bucket: False), ANSWERS)
    windows = by_block(laid).cogroup(by_block(live)).applyInArrow(send_windows, KEYS)
    gone = windows.groupBy("bucket").applyInArrow(answer(8, lambda bucket: True), ANSWERS)
    schema = T.StructType([laid.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept_text string").fields])
    return by_block(laid).cogroup(by_block(live.unionByName(gone))).applyInArrow(cut, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs, ["doc_id"]).select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def shortened(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated words removed from text, and n_chars counted anew.

    Documents that lose nothing keep their text as it is (null becomes empty); one that loses
    all its words stays, with an empty text.
    """
    cut = remove_repeats(docs, keep_untouched=True)

    def column(name: str):
        if name == "text":
            return F.col("kept_text").alias("text")
        if name == "n_chars":
            counted = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars"))
            return counted.cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"row.`{name}`").alias(name)

    return cut.select(*map(column, docs.columns))
