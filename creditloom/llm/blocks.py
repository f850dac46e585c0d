"""Finding what repeats across blocks of documents, a bucket of keys at a time.

Documents are laid out in blocks of about ``BLOCK_BYTES`` of text, once. Each block turns its
positions into 64-bit keys and sends every distinct key once, in the bucket its hash names, so
a key that millions of documents hold costs one entry per block and no bucket grows hot. A
bucket, about ``BUCKET_KEYS`` keys, is sorted in one task, which answers each block with one
bit per key it sent. Blocks recompute their keys when the answer arrives; nothing else is
kept. The numbers of blocks and buckets follow the measured size of the input. Two things grow
all the same: a key that all blocks hold has an entry per block in its one bucket, and a text
is never cut, so a block holds its longest text whole, with some eight arrays of eight bytes
per byte.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BUCKET_KEYS = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLES = np.random.default_rng(20240117).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * U(2) + U(1)

KEYS = "bucket long, block long, keys binary, owners binary, many binary"
ANSWERS = "block long, bucket long, bits binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were needed yet."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            self.up, self.down = np.full(self.n, self.base, U), np.full(self.n, self.inverse, U)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up[:n], self.down[:n]


_POWERS = Powers(_BASE)


class Rolling:
    """Hashes of any spans of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _POWERS.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def byte_values(raw: np.ndarray, table: int = 0) -> np.ndarray:
    return _TABLES[table][raw]


class Texts:
    """The texts of one block as bytes, in order of id and text, each followed by a line feed."""

    def __init__(self, block: pa.Table) -> None:
        ids, texts = block.column("id").to_pylist(), block.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in self.order]
        self.raw = [texts[i].encode() for i in self.order]
        self.lengths = np.array([len(x) for x in self.raw], np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.bytes = np.frombuffer(b"\n".join(self.raw) + b"\n", np.uint8)

    def row(self, block: pa.Table) -> pa.Array:
        """The carried columns, in the same order."""
        return block.column("row").combine_chunks().take(pa.array(self.order, pa.int64()))


class Distinct:
    """The distinct keys of a block by bucket, and which position holds which."""

    def __init__(self, keys: np.ndarray, buckets: np.ndarray) -> None:
        order = np.lexsort((keys, buckets))
        ordered_keys, ordered_buckets = keys[order], buckets[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (ordered_keys[1:] != ordered_keys[:-1]) | (ordered_buckets[1:] != ordered_buckets[:-1])
        self.keys, self.buckets = ordered_keys[fresh], ordered_buckets[fresh]
        self.first = np.flatnonzero(fresh)
        self.counts = np.diff(np.append(self.first, len(keys)))
        self.order = order
        self.of = np.empty(len(keys), np.int64)
        self.of[order] = np.cumsum(fresh) - 1

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least of the positions' values, by key."""
        return np.minimum.reduceat(values[self.order], self.first) if len(self.keys) else values[:0]

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(flags[self.order], self.first) if len(self.keys) else flags[:0]

    def sent(self, block: int, many: np.ndarray, owners: np.ndarray | None = None, width: int = 8, offset: int = 0) -> list[tuple]:
        """One row per bucket: keys (their lowest ``width`` bytes), owners, flags."""
        out = []
        named, cuts = np.unique(self.buckets, return_index=True)
        cuts = np.append(cuts, len(self.keys))
        packed = self.keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        for bucket, a, b in zip(named.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append((bucket + offset, block, packed[a:b].tobytes(), b"" if owners is None else owners[a:b].astype("<i8").tobytes(), (np.packbits(many[a:b]) if many.dtype == bool else many[a:b]).tobytes()))
        return out

    def counted(self, answers: dict[int, bytes]) -> np.ndarray:
        """The byte told of every distinct key by ``count_answer``."""
        named = np.unique(self.buckets).tolist()
        return np.frombuffer(b"".join(answers[b] for b in named), np.uint8) if named else np.zeros(0, np.uint8)

    def answered(self, answers: dict[int, bytes], offset: int = 0) -> np.ndarray:
        """The answer to every distinct key."""
        out = np.zeros(len(self.keys), bool)
        named, cuts = np.unique(self.buckets, return_index=True)
        cuts = np.append(cuts, len(self.keys))
        for bucket, a, b in zip(named.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[a:b] = np.unpackbits(np.frombuffer(answers[bucket + offset], np.uint8), count=b - a)
        return out


def count_answer(width: int) -> Callable[[pa.Table], pa.Table]:
    """How many holders each key has over all blocks, up to 255: one byte per key sent.

    The flags of a block are its own counts here, a byte per key.
    """

    def run(table: pa.Table) -> pa.Table:
        blobs, counts = table.column("keys").to_pylist(), table.column("many").to_pylist()
        sizes = [len(b) // width for b in blobs]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :width] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        found, group = np.unique(keys.reshape(-1).view("<u8"), return_inverse=True)
        total = np.bincount(group, np.frombuffer(b"".join(counts), np.uint8), len(found))
        told = np.minimum(total, 255).astype(np.uint8)[group]
        cuts = np.cumsum([0, *sizes])
        bits = [told[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": table.column("block").combine_chunks(), "bucket": table.column("bucket").combine_chunks(), "bits": pa.array(bits, pa.binary())})

    return run


def answer(width: int, owned: Callable[[int], bool]) -> Callable[[pa.Table], pa.Table]:
    """What a bucket says of each key sent to it.

    Without owners: whether the key is flagged or came from another block too. With owners:
    whether another block has it with a smaller owner.
    """

    def run(table: pa.Table) -> pa.Table:
        blobs, flags = table.column("keys").to_pylist(), table.column("many").to_pylist()
        sizes = [len(b) // width for b in blobs]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :width] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        keys = keys.reshape(-1).view("<u8")
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        told = np.empty(len(keys), bool)
        if owned(table.column("bucket")[0].as_py()):
            owners = np.frombuffer(b"".join(table.column("owners").to_pylist()), "<i8")[order]
            told[order] = owners > np.minimum.reduceat(owners, first)[group]
        else:
            many = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(flags, sizes, strict=True)]).astype(bool)[order]
            told[order] = (np.diff(np.append(first, len(keys))) > 1)[group] | np.maximum.reduceat(many, first)[group]
        cuts = np.cumsum([0, *sizes])
        bits = [np.packbits(told[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": table.column("block").combine_chunks(), "bucket": table.column("bucket").combine_chunks(), "bits": pa.array(bits, pa.binary())})

    return run


def keys_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "block", "keys", "owners", "many"), columns, kinds, strict=True)})


def size_of(docs: DataFrame) -> int:
    """Bytes of text, counted over all rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def lay_out(docs: DataFrame, n_bytes: int, carry: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, id, text, row: a row's block depends on its id and text alone."""
    n = max(1, -(-n_bytes // block_bytes))
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(n)).alias("block"), F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.struct(*carry).alias("row"))
