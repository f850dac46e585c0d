"""Phrase collocation mining: how much oftener words stand together than their parts suggest.

A phrase of a frequent length-k phrase and one more word can only be frequent if its last k
words are frequent as well, so frequent phrases are found length by length:

1. Words are counted per language; the frequent ones get numbers. Texts become arrays of
   numbers, 0 for a border or a rare word, kept in shards of about ``SHARD`` words.
2. Candidates of length k + 1 stand at places where a frequent phrase of length k starts, and
   another one word later. Their occurrences are counted by hash first: tasks send sums by
   bucket, packed in slices of buckets and cut at the least count, and only phrases in a bucket that reaches the least count are named. A phrase can't
   be more frequent than its bucket, so none is missed, and few others are left.
3. The candidates become a double-array trie, which is broadcast. From the places of the
   phrases of length k, numpy takes all places' states one word on at once; a bincount of the
   states reached counts all candidates of a task, and Spark sums the tasks' counts.

A trie of frequent phrases, as deep as found yet, leads every pass to its places again. Each
broadcast is bounded: the words by ``VOCABULARY``, a trie by ``TRANSITIONS``, the
buckets by ``BUCKETS``, and all that a pass walks through by ``SLOTS``. What is beyond is cut into parts by ranges of the phrases,
each with a pass of its own, and places found so far are written in between; so any number of
frequent phrases is counted exactly. Only parts within these bounds pass through the driver.

Each phrase's score is the least over its cuts, computed with decimals of 38 digits. Phrases
that are inside a longer one with (about) the same count are dropped: since every phrase
between the two is as frequent as the longer, it is enough to look at those one word longer.

Edge cases: null and empty texts have no words; a null language is ``und`` and shares its
numbers with documents so marked; repeated rows count each time; ties go by count and phrase;
an empty table gives no rows; other columns are not read. A text of any length is handled at
once by one task as bytes; its numbers are cut at borders into shards.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SHARD = 1 << 19
#: A task sends its sums after so many words.
UNIT = 1 << 23
VOCABULARY = 1 << 18
TRANSITIONS = 1 << 18
SLOTS = 1 << 22
BUCKETS = 1 << 22
#: Counts and names go in slices of so many states or buckets, each first in so many lanes of tasks.
SLICE = 1 << 12
LANES = 16
#: Distinct words a task counts before it sends what it has.
HELD = 1 << 19
#: Bits of the hash that sorts candidates into buckets, and of a bucket's place in its slice.
BUCKET_BITS = 30
PLACE_BITS = 16
#: Slices of words that are counted together.
WORD_SLICES = 512

#: Marks the border of a piece among words; never a byte of UTF-8.
BORDER = b"\xff"
_BYTES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BORDER * 10 + b" ")


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words, and the borders of pieces between them."""
    return text.lower().translate(_BYTES).replace(BORDER, b" \xff ").split()


def squeezed(numbers: np.ndarray, steps: bool = False) -> bytes:
    """Numbers of 32 bits in few bytes, for what is written or sent; with ``steps`` their differences."""
    numbers = np.ascontiguousarray(numbers, np.int32)
    numbers = (np.diff(numbers, prepend=np.int32(0)) if steps else numbers).astype("<i4")
    # All lowest bytes come first, then the next ones: the high ones are mostly alike.
    raw = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(held: bytes, steps: bool = False) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    numbers = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(-1)
    return np.cumsum(numbers, dtype=np.int32) if steps else numbers


class Trie:
    """A double array: from state s, word w leads to slot base[s] + w if check there is s."""

    def __init__(self, parents: np.ndarray, words: np.ndarray, offset: int) -> None:
        """``offset`` is added to slots, so that the states of several tries differ."""
        order = np.lexsort((words, parents))
        parents, words = parents[order], words[order].astype(np.int64)
        self.offset = offset
        self.low = int(parents[0]) if len(parents) else 0
        heads, first, counts = np.unique(parents, return_index=True, return_counts=True)
        span = int(words.max(initial=0)) + 1
        used = np.zeros(2 * len(words) + span + 600, bool)
        used[0] = True
        slots = np.zeros(len(words), np.int64)
        base = np.full(int(heads[-1]) - self.low + 1 if len(heads) else 1, -(1 << 30), np.int64)
        cursor = 1
        several = np.flatnonzero(counts > 1)
        for k in several[np.argsort(-counts[several], kind="stable")].tolist():
            children = words[first[k] : first[k] + counts[k]]
            ahead = children - children[0]
            while True:
                if cursor + 300 + int(ahead[-1]) >= len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                tries = np.flatnonzero(~used[cursor : cursor + 256]) + cursor
                if len(tries):
                    for few in (tries[:8], tries[8:]):
                        fits = ~used[few[:, None] + ahead].any(axis=1) if len(few) else np.zeros(0, bool)
                        if fits.any():
                            break
                    if fits.any():
                        at = int(few[int(np.argmax(fits))])
                        break
                cursor += 256
            slots[first[k] : first[k] + counts[k]] = at + ahead
            used[at + ahead] = True
            base[int(heads[k]) - self.low] = at - int(children[0])
        single = np.flatnonzero(counts == 1)
        free = np.flatnonzero(~used)
        if len(free) < len(single):
            free = np.concatenate([free, np.arange(len(used), len(used) + len(single) - len(free))])
        slots[first[single]] = free[: len(single)]
        base[heads[single] - self.low] = free[: len(single)] - words[first[single]]
        # The first and the last slot stay empty: they answer for all that lies outside.
        self.size = int(slots.max(initial=0)) + 2
        self.base = base.astype(np.int32)
        self.check = np.full(self.size, -1, np.int32)
        self.check[slots] = parents

    def step(self, at: np.ndarray, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that have a transition, and the slots it leads to."""
        inside = (states >= self.low) & (states < self.low + len(self.base))
        at, states = at[inside], states[inside]
        slots = np.clip(self.base[states - self.low] + words[at], 0, self.size - 1)
        found = self.check[slots] == states
        return at[found], slots[found]

    def keep(self, slots: np.ndarray) -> None:
        """Forget all transitions but those to ``slots``."""
        kept = np.full(self.size, -1, np.int32)
        kept[slots] = self.check[slots]
        self.check = kept


# ---- passes over the shards

#: All are squeezed. words: numbers of the shard. at, state: places found and their states, at the length that
#: was reached when the rows were written; next_at, next_state: those found so far one further.
STATE = "words binary, reached int, at binary, state binary, next_at binary, next_state binary"


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


class Place:
    """The places of a shard while a pass leads them through the tries."""

    def __init__(self, words: bytes, reached: int | None = None, *saved: bytes) -> None:
        numbers = unsqueezed(words)
        self.size = len(numbers)
        self.words = np.concatenate([numbers, np.zeros(8, np.int32)])
        self.reached = reached or 1
        if saved and saved[0] is not None:
            self.at, self.states, self.next_at, self.next_states = (unsqueezed(x, k % 2 == 0) for k, x in enumerate(saved))
        else:
            self.at = np.flatnonzero(self.words).astype(np.int32)
            self.states = self.words[self.at]
            self.next_at = self.next_states = np.zeros(0, np.int32)

    def through(self, trie: Trie | None) -> None:
        """One trie of the next length, or (None) on to that length."""
        if trie is None:
            order = np.argsort(self.next_at, kind="stable")
            self.at, self.states = self.next_at[order], self.next_states[order]
            self.next_at = self.next_states = np.zeros(0, np.int32)
            self.reached += 1
        else:
            at, slots = trie.step(self.at, self.states, self.words[self.reached :])
            self.next_at = np.concatenate([self.next_at, at])
            self.next_states = np.concatenate([self.next_states, (slots + trie.offset).astype(np.int32)])

    def saved(self, words: bytes) -> tuple:
        return (words, self.reached, *(squeezed(x, k % 2 == 0) for k, x in enumerate((self.at, self.states, self.next_at, self.next_states))))


class Walk:
    """The shards, and the tries that lead to the places of the longest phrases found."""

    def __init__(self, shards: DataFrame, slots: int) -> None:
        self.shards, self.limit = shards, slots
        self.tries: list = []
        self.held = 0

    def places(self) -> Callable[[pa.RecordBatch], Iterator[tuple[bytes, Place]]]:
        tries, names = list(self.tries), self.shards.columns

        def run(batch: pa.RecordBatch) -> Iterator[tuple[bytes, Place]]:
            columns = [batch.column(n) for n in names]
            for row in range(batch.num_rows):
                words, *rest = (c[row].as_py() for c in columns)
                place = Place(words, *rest)
                for trie in tries:
                    place.through(None if trie is None else trie.value)
                yield words, place

        return run

    def add(self, trie: Trie) -> None:
        """Lead through another trie of the next length, after writing the places if tries get too many."""
        if self.tries and self.held + trie.size > self.limit:
            self.write()
        self.tries.append(self.shards.sparkSession.sparkContext.broadcast(trie))
        self.held += trie.size

    def on(self) -> None:
        self.tries.append(None)

    def write(self) -> None:
        places = self.places()

        def run(batches):
            for batch in batches:
                for words, place in places(batch):
                    yield pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in STATE.split(", ")], place.saved(words), strict=True))], _SCHEMA)

        self.shards = checkpoint(self.shards.mapInArrow(run, STATE))
        for trie in self.tries:
            if trie is not None:
                trie.unpersist()
        self.tries, self.held = [], 0

    def candidates(self, least: int, unit: int, most: int) -> DataFrame:
        """parent, word: the phrases one word longer that may be frequent."""
        places, context = self.places(), self.shards.sparkSession.sparkContext

        def found(place: Place) -> np.ndarray:
            """Keys of the shard's phrases one word longer whose parts are frequent."""
            followed = np.zeros(len(place.words) + 1, bool)
            followed[place.at] = True
            able = followed[place.at + 1]
            return place.states[able].astype(np.int64) << 32 | place.words[place.at[able] + place.reached]

        def sums(parts: list[tuple]) -> pa.RecordBatch:
            """A row per slice of buckets. A sum is cut at ``least``, which is all that is asked of it."""
            buckets, group = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.minimum(np.bincount(group, np.concatenate([p[1] for p in parts]), len(buckets)), least).astype(kind)
            slices, first = np.unique(buckets >> PLACE_BITS, return_index=True)
            at = (buckets & (1 << PLACE_BITS) - 1).astype("<u2")
            rows = zip(slices.tolist(), np.split(at, first[1:]), np.split(n, first[1:]), strict=False)
            return pa.RecordBatch.from_pylist([{"slice": k, "at": x.tobytes(), "sums": y.tobytes()} for k, x, y in rows], _BUCKETS)

        def count(batches):
            parts, words = [], 0
            for batch in batches:
                for _, place in places(batch):
                    parts.append(np.unique(bucket_of(found(place)), return_counts=True))
                    words += place.size
                    if words >= unit:
                        yield sums(parts)
                        parts, words = [], 0
            if parts:
                yield sums(parts)

        def reaching(table: pa.Table) -> pa.Table:
            total = np.zeros(1 << PLACE_BITS, np.int64)
            for at, n in zip(table.column("at").to_pylist(), table.column("sums").to_pylist(), strict=True):
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, kind)
            reached = np.flatnonzero(total >= least) + (table.column("slice")[0].as_py() << PLACE_BITS)
            return pa.table({"bucket": pa.array(reached.astype(np.int32))})

        kind = np.dtype(np.min_scalar_type(max(1, least))).newbyteorder("<")
        counted = self.shards.mapInArrow(count, "slice int, at binary, sums binary").groupBy("slice")
        frequent = checkpoint(counted.applyInArrow(reaching, "bucket int"))
        parts = max(1, -(-frequent.count() // most))
        out = []
        for part in range(parts):
            mine = frequent.where(F.pmod("bucket", F.lit(parts)) == part).toArrow().column("bucket").to_numpy()
            out.append(self.named(found, np.sort(mine), unit).groupBy("slice").applyInArrow(spread, "parent long, word long"))
        return union_all(out)

    def named(self, found: Callable[[Place], np.ndarray], frequent: np.ndarray, unit: int) -> DataFrame:
        """slice, lane, keys: the different keys found in ``frequent`` buckets, packed.

        A task names a key once per ``unit`` words, however many shards hold it. A slice holds
        the keys of a run of buckets; it is united by lanes of tasks here, and then whole.
        """
        places, shared = self.places(), self.shards.sparkSession.sparkContext.broadcast(frequent)

        def packed_keys(parts: list[np.ndarray], buckets: np.ndarray) -> pa.RecordBatch:
            keys = np.unique(np.concatenate(parts))
            slices = np.searchsorted(buckets, bucket_of(keys)) // SLICE
            order = np.argsort(slices, kind="stable")
            keys, (numbers, first) = keys[order], np.unique(slices[order], return_index=True)
            lane = TaskContext.get().partitionId() % LANES
            rows = [{"slice": k, "lane": lane, "keys": held.tobytes()} for k, held in zip(numbers.tolist(), np.split(keys, first[1:]), strict=False)]
            return pa.RecordBatch.from_pylist(rows, _NAMED)

        def name(batches):
            buckets, parts, words = shared.value, [], 0
            for batch in batches:
                for _, place in places(batch) if len(buckets) else ():
                    keys = np.unique(found(place))
                    of = bucket_of(keys)
                    parts.append(keys[buckets[np.minimum(np.searchsorted(buckets, of), len(buckets) - 1)] == of])
                    words += place.size
                    if words >= unit:
                        yield packed_keys(parts, buckets)
                        parts, words = [], 0
            if parts:
                yield packed_keys(parts, buckets)

        def unite(table: pa.Table) -> pa.Table:
            row = {"slice": table.column("slice")[0].as_py(), "lane": table.column("lane")[0].as_py(), "keys": united(table).tobytes()}
            return pa.Table.from_pylist([row], _NAMED)

        return self.shards.mapInArrow(name, "slice long, lane int, keys binary").groupBy("slice", "lane").applyInArrow(unite, "slice long, lane int, keys binary")

    def counts(self, trie: Trie, least: int) -> DataFrame:
        """state, parent, word, f of the trie's transitions met ``least`` times, summed over the shards.

        A task sends its bincount in slices, of which only what is not zero is packed. A slice
        is summed by lanes of tasks and then whole, so a sum takes in few rows of bounded size.
        """
        places, shared = self.places(), self.shards.sparkSession.sparkContext.broadcast(trie)

        def run(batches):
            tail = shared.value
            total = np.zeros(-(-tail.size // SLICE) * SLICE, np.int64)
            for batch in batches:
                for _, place in places(batch):
                    _, slots = tail.step(place.at, place.states, place.words[place.reached :])
                    total += np.bincount(slots, minlength=len(total))
            lane = TaskContext.get().partitionId() % LANES
            rows = [(k, lane, *packed(total[k * SLICE : (k + 1) * SLICE])) for k in range(len(total) // SLICE) if total[k * SLICE : (k + 1) * SLICE].any()]
            yield pa.RecordBatch.from_pylist([dict(zip(_SLICED.names, row, strict=True)) for row in rows], _SLICED)

        def add(table: pa.Table) -> pa.Table:
            row = (table.column("slice")[0].as_py(), table.column("lane")[0].as_py(), *packed(unpacked(table)))
            return pa.Table.from_pylist([dict(zip(_SLICED.names, row, strict=True))], _SLICED)

        def finish(table: pa.Table) -> pa.Table:
            tail, sums = shared.value, unpacked(table)
            frequent = np.flatnonzero(sums >= least)
            reached = frequent + table.column("slice")[0].as_py() * SLICE
            parents = tail.check[reached].astype(np.int64)
            words = reached - tail.base[parents - tail.low]
            return pa.table({"state": pa.array(reached + tail.offset), "parent": pa.array(parents), "word": pa.array(words), "f": pa.array(sums[frequent])})

        sliced = self.shards.mapInArrow(run, "slice long, lane int, at binary, sums binary")
        sliced = sliced.groupBy("slice", "lane").applyInArrow(add, "slice long, lane int, at binary, sums binary")
        return sliced.groupBy("slice").applyInArrow(finish, "state long, parent long, word long, f long")


def united(table: pa.Table) -> np.ndarray:
    """The different keys of packed ones."""
    return np.unique(np.concatenate([np.frombuffer(keys, np.int64) for keys in table.column("keys").to_pylist()]))


def spread(table: pa.Table) -> pa.Table:
    """parent, word: the different keys of a slice."""
    keys = united(table)
    return pa.table({"parent": pa.array(keys >> 32), "word": pa.array(keys & 0xFFFFFFFF)})


def packed(sums: np.ndarray) -> tuple[bytes, bytes]:
    """A slice's places that are not zero, and their sums."""
    at = np.flatnonzero(sums)
    return at.astype("<u2").tobytes(), sums[at].astype("<i8").tobytes()


def unpacked(table: pa.Table) -> np.ndarray:
    """The sum of packed slices."""
    out = np.zeros(SLICE, np.int64)
    for at, sums in zip(table.column("at").to_pylist(), table.column("sums").to_pylist(), strict=True):
        out[np.frombuffer(at, "<u2")] += np.frombuffer(sums, "<i8")
    return out


_SLICED = pa.schema([("slice", pa.int64()), ("lane", pa.int32()), ("at", pa.binary()), ("sums", pa.binary())])
_WORDS = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("words", pa.binary()), ("sums", pa.binary())])
_BUCKETS = pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("sums", pa.binary())])
_NAMED = pa.schema([("slice", pa.int64()), ("lane", pa.int32()), ("keys", pa.binary())])
_SCHEMA = pa.schema([("words", pa.binary()), ("reached", pa.int32()), ("at", pa.binary()), ("state", pa.binary()), ("next_at", pa.binary()), ("next_state", pa.binary())])


# ---- words and shards


def count_words(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, word, f; the row without a word counts all of a language.

    A task sends the words of a slice as one row: a hash deals words to slices, in which their
    sorted texts take few bytes.
    """

    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        out = []
        for lang, found in counts.items():
            found.pop(BORDER, 0)
            slices: list[list[bytes]] = [[] for _ in range(WORD_SLICES)]
            for word in found:
                slices[zlib.crc32(word) % WORD_SLICES].append(word)
            out.append({"lang": lang, "slice": -1, "words": None, "sums": np.array([found.total()], "<i8").tobytes()})
            for k, words in enumerate(slices):
                if words:
                    words.sort()
                    raw = b" ".join(words)
                    sums = np.array([found[w] for w in words], "<i8").tobytes()
                    out.append({"lang": lang, "slice": k, "words": len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True), "sums": pa.compress(sums, codec="zstd", asbytes=True)})
        return pa.RecordBatch.from_pylist(out, _WORDS)

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts[lang].update(tokens(text))
                if sum(map(len, counts.values())) > held:
                    yield rows(counts)
                    counts = defaultdict(Counter)
        yield rows(counts)

    def add(table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for words, sums in zip(table.column("words").to_pylist(), table.column("sums").to_pylist(), strict=True):
            if words is None:
                total[None] += int.from_bytes(sums, "little")
            else:
                listed = pa.decompress(words[8:], int.from_bytes(words[:8], "little"), codec="zstd", asbytes=True).split(b" ")
                for word, n in zip(listed, np.frombuffer(pa.decompress(sums, 8 * len(listed), codec="zstd", asbytes=True), "<i8").tolist(), strict=True):
                    total[word] += n
        names = pa.array([*total], pa.binary()).cast(pa.string())
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(total), pa.string()), "word": names, "f": pa.array([*total.values()], pa.int64())})

    sliced = docs.mapInArrow(run, "lang string, slice int, words binary, sums binary")
    return sliced.groupBy("lang", "slice").applyInArrow(add, "lang string, word string, f long")


def numbered(words: DataFrame, part: int, parts: int) -> tuple[pa.Table, dict[str, dict[bytes, int]]]:
    """The words of a part with their numbers, which no other part uses; 0 is no word's."""
    table = words.where(F.pmod(F.xxhash64("lang", "word"), F.lit(parts)) == part).orderBy("lang", "word").toArrow()
    numbers = np.arange(table.num_rows, dtype=np.int64) * parts + part + 1
    table = table.append_column("word_id", pa.array(numbers))
    by_lang: dict[str, dict[bytes, int]] = defaultdict(dict)
    for lang, word, number in zip(table.column("lang").to_pylist(), table.column("word").to_pylist(), numbers.tolist(), strict=True):
        by_lang[lang][word.encode()] = number
    return table, dict(by_lang)


def shards_of(numbers: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Shards of about ``size``, cut at borders, and the rest."""
    out = []
    while len(numbers) >= size:
        borders = np.flatnonzero(numbers[size - 1 :] == 0)[:1]
        if not len(borders):
            break
        out.append(numbers[: size + int(borders[0])])
        numbers = numbers[size + int(borders[0]) :]
    return out, numbers


def write_shards(docs: DataFrame, vocabulary: list, size: int) -> DataFrame:
    """words: the shards. ``vocabulary`` is a list of words by language, one pass each."""
    context = docs.sparkSession.sparkContext
    # Until the last part, texts stay beside the numbers found so far.
    rows = docs.select("lang", F.col("text").alias("tokens"), F.lit(None).cast("binary").alias("words"))
    for k, part in enumerate(vocabulary):
        shared, last = context.broadcast(part), k == len(vocabulary) - 1

        def run(batches, shared=shared, last=last):
            known, waiting, held = shared.value, [], 0

            def row(shard):
                return pa.RecordBatch.from_arrays([pa.array([squeezed(shard)], pa.binary())], names=["words"])

            for batch in batches:
                langs, texts, before = (batch.column(c).to_pylist() for c in ("lang", "tokens", "words"))
                found = []
                for lang, text, earlier in zip(langs, texts, before, strict=True):
                    words = tokens(text)
                    of = known.get(lang, {})
                    numbers = np.fromiter((of.get(w, 0) for w in words), np.int32, len(words))
                    if earlier is not None:
                        numbers = np.maximum(numbers, unsqueezed(earlier))
                    found.append(numbers)
                if not last:
                    packed = [squeezed(x) for x in found]
                    yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("tokens"), pa.array(packed, pa.binary())], names=["lang", "tokens", "words"])
                    continue
                for numbers in found:
                    numbers = np.append(numbers, np.int32(0))
                    numbers = numbers[(numbers != 0) | (np.append(np.int32(0), numbers[:-1]) != 0)]
                    waiting.append(numbers)
                    held += len(numbers)
                    if held >= size:
                        ready, rest = shards_of(np.concatenate(waiting), size)
                        waiting, held = [rest], len(rest)
                        yield from map(row, ready)
            if held:
                yield row(np.concatenate(waiting))

        rows = checkpoint(rows.mapInArrow(run, "words binary" if last else "lang string, tokens binary, words binary"))
        shared.unpersist()
    return rows


def parts_of(candidates: DataFrame, n: int, size: int) -> list[DataFrame]:
    """The candidates in ranges of about ``size``."""
    if n <= size:
        return [candidates]
    key = F.shiftleft("parent", 31).bitwiseOR(F.col("word"))
    parts = -(-n // size)
    cuts = candidates.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
    cuts = [-1, *sorted(set(cuts)), (1 << 63) - 1]
    return [candidates.where((key > a) & (key <= b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, shard: int = SHARD, unit: int = UNIT, vocabulary: int = VOCABULARY, transitions: int = TRANSITIONS, slots: int = SLOTS, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, size, word_ids, phrase, f): all phrases of up to ``longest`` words met ``least`` times.

    ``docs`` has lang and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = checkpoint(count_words(docs).where((F.col("f") >= least) | F.col("word").isNull()))
    totals = counted.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    words = counted.where(F.col("word").isNotNull())
    parts = max(1, -(-words.count() // vocabulary))
    known, tables = [], []
    for part in range(parts):
        table, by_lang = numbered(words, part, parts)
        known.append(by_lang)
        tables.append(checkpoint(spark.createDataFrame(table.select(["lang", "word", "f", "word_id"])) if table.num_rows else spark.createDataFrame([], "lang string, word string, f long, word_id long")))
    singles = union_all(tables)
    shards = write_shards(docs, known, shard)
    del known
    reached = singles.select("lang", F.col("word_id").alias("state"), F.array("word_id").alias("word_ids"), F.col("word").alias("phrase"), "f")
    out, walk = [reached], Walk(shards, slots)
    for size in range(2, longest + 1):
        candidates = checkpoint(walk.candidates(least, unit, buckets))
        n = candidates.count()
        if not n:
            break
        offset, found, tries = 1, [], []
        for part in parts_of(candidates, n, transitions):
            table = part.toArrow()
            if not table.num_rows:
                continue
            trie = Trie(table.column("parent").to_numpy(), table.column("word").to_numpy(), offset)
            counts = checkpoint(walk.counts(trie, least))
            kept = counts.select("state").toArrow().column("state").to_numpy()
            found.append(counts)
            if len(kept):
                trie.keep(kept - offset)
                tries.append(trie)
            offset += trie.size
        for trie in tries:
            walk.add(trie)
        walk.on()
        longer = union_all(found)
        before = reached.select(F.col("state").alias("parent"), "lang", "word_ids", "phrase")
        last = singles.select(F.col("word_id").alias("word"), F.col("word").alias("text"))
        longer = longer.join(before, "parent").join(last, "word")
        reached = checkpoint(longer.select("lang", "state", F.concat("word_ids", F.array("word")).alias("word_ids"), F.concat_ws(" ", "phrase", "text").alias("phrase"), "f"))
        out.append(reached)
        if not tries or size == longest:
            break
    phrases = union_all(out)
    return totals, phrases.select("lang", F.size("word_ids").alias("size"), "word_ids", "phrase", "f")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, inside: int = 100, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of every language.

    A phrase is dropped if a longer one that contains it has ``inside`` per cent of its count.
    """
    totals, phrases = frequent_phrases(docs, least, longest, **sizes)
    several = phrases.where("size > 1")
    # The phrases that lose their first or last word to become this one.
    longer = several.where("size > 2").select(F.explode(F.array(F.expr("slice(word_ids, 1, size - 1)"), F.expr("slice(word_ids, 2, size - 1)"))).alias("word_ids"), F.col("f").alias("within"))
    longer = longer.groupBy("word_ids").agg(F.max("within").alias("within"))
    kept = several.join(longer, "word_ids", "left").where(F.col("within").isNull() | (F.col("within") * 100 < F.col("f") * inside)).drop("within")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr("slice(word_ids, 1, k)")).withColumn("right", F.expr("slice(word_ids, k + 1, size - k)"))
    parts = phrases.select(F.col("word_ids").alias("part"), F.col("f").alias("of_part"))
    cuts = cuts.join(parts.select(F.col("part").alias("left"), F.col("of_part").alias("l")), "left").join(parts.select(F.col("part").alias("right"), F.col("of_part").alias("r")), "right")
    cuts = cuts.join(totals, "lang")
    a, n, left, right = (F.col(c).cast("decimal(18,0)") for c in ("f", "n", "l", "r"))
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * (a * n)).withColumn("under", left * right)
    cuts = cuts.withColumn("score", F.expr("over div under"))
    least_cut = cuts.groupBy("word_ids").agg(F.min(F.struct("score", "k", "l", "r", "n", "lang", "phrase", F.col("f").alias("a"))).alias("cut")).select("cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = least_cut.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
