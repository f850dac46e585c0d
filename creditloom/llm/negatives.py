"""Hard-negative mining by exact scores from subset-sum tables.

Components become integers, ``floor(scale * x)``. Every eight dimensions form a group. For an
anchor, a table of 256 entries a group holds the sums of all subsets of its eight components.
A row's integers are kept as bit planes, a byte a group and plane (two's complement), so its
inner product with the anchor is a lookup a byte, shifted by the plane and added, the last
plane subtracted. Scores are exact integers.

Anchors and rows are dealt to blocks, and a task scores one block of anchors against one block
of rows, in tiles. It gives back the best few of an anchor in its block, so what is merged is
small. First the positives of all anchors are found, among rows of their label; then, with the
bounds that follow from each positive's score, the negatives, among rows of other labels. Rows
are dealt by a hash of the whole row, after equal rows are counted: neither a hot label nor a
row repeated many times makes a block large.

Edge cases. Rows with a null label, a null vector, or a null or non-finite component take no
part. A row without an id comes after all that have one, among equal scores. Equal rows are one
anchor, and each counts as a positive or negative of its own. Rows with an anchor's id are
never its positives or negatives. Shorter vectors count as filled up with zeros. Ties go to the
smaller id. An empty table gives no rows; an anchor without other rows of its label, or with
no row within the bounds, gives none. Other columns are not read. Scores that 64 bits can't
hold are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: A task's block holds at most about so many rows and anchors; a tile so many.
ROWS = 1 << 17
ANCHORS = 1 << 12
TILE_ROWS, TILE_ANCHORS = 2048, 64
#: Small inputs are cut further, into so many blocks of at least so many anchors.
SPREAD, LEAST = 8, 16

FOUND = "anchor long, mark binary, place int, positive_id long, positive_score long, id long, score long"


def pack(components: np.ndarray, bits: int) -> np.ndarray:
    """Rows of integers (n x 8g) as bytes, n x bits x g: bit j of a byte is that of component j."""
    n, width = components.shape
    planes = (components[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8).reshape(n, bits, width // 8, 8), axis=3, bitorder="little")[..., 0]


def unpack(planes: np.ndarray) -> np.ndarray:
    """The integers that ``pack`` packed."""
    n, bits, groups = planes.shape
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.einsum("nbk,b->nk", np.unpackbits(planes, axis=2, bitorder="little").reshape(n, bits, groups * 8).astype(np.int64), weights)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """g x 256 x n: for each group of eight components the sums of all subsets."""
    n, width = anchors.shape
    parts = np.ascontiguousarray(anchors.reshape(n, width // 8, 8).transpose(1, 2, 0)).astype(kind)
    out = np.zeros((width // 8, 256, n), kind)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + parts[:, j, None]
    return out


class Scores:
    """Scores of a block's rows with any anchors."""

    def __init__(self, planes: np.ndarray) -> None:
        # By plane and group, so that a lookup reads one run of bytes.
        self.bytes = np.ascontiguousarray(planes.transpose(1, 2, 0))
        self.bits, self.groups, self.n = self.bytes.shape

    def of(self, anchors: np.ndarray) -> np.ndarray:
        """n rows x anchors, 64-bit."""
        largest = int(np.abs(anchors).max(initial=0)) * max(1, anchors.shape[1])
        kind = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64
        tables = subset_sums(anchors, kind)
        out = np.zeros((self.n, len(anchors)), np.int64)
        for start in range(0, self.n, TILE_ROWS):
            rows = slice(start, min(self.n, start + TILE_ROWS))
            looked, plane = (np.empty((rows.stop - start, len(anchors)), kind) for _ in range(2))
            for bit in range(self.bits):
                plane[:] = 0
                for group in range(self.groups):
                    np.take(tables[group], self.bytes[bit, group, rows], axis=0, out=looked, mode="clip")
                    plane += looked
                shifted = plane.astype(np.int64) << bit
                if bit == self.bits - 1:
                    out[rows] -= shifted
                else:
                    out[rows] += shifted
        return out


def best(scores: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores among the wanted ones, earlier places first among equals."""
    places = np.flatnonzero(wanted)
    if len(places) > k:
        among = scores[places]
        places = places[among >= np.partition(among, len(among) - k)[len(among) - k]]
    return places[np.argsort(-scores[places], kind="stable")[:k]]


def planes_of(column: pa.Array, bits: int, groups: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, bits, groups)


class Block:
    """Rows of a block, ordered by id, those without an id last."""

    def __init__(self, rows: pa.Table, bits: int, groups: int) -> None:
        ids = rows.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        rows = rows.take(pa.array(order, pa.int64()))
        self.ids, self.labels = rows.column("id").to_pylist(), np.array(rows.column("label").to_pylist(), object)
        self.known = np.array([i is not None for i in self.ids], bool)
        self.numbers = np.array([i or 0 for i in self.ids], np.int64)
        self.copies = rows.column("copies").to_pylist()
        self.planes = planes_of(rows.column("planes"), bits, groups)

    def others(self, anchor: int) -> np.ndarray:
        return ~self.known | (self.numbers != anchor)

    def told(self, places: np.ndarray, k: int) -> list[int]:
        """The places, each as often as equal rows stand behind it, k at most."""
        out: list[int] = []
        for place in places.tolist():
            out += [place] * min(self.copies[place], k - len(out))
        return out


def found_table(rows: list[tuple]) -> pa.Table:
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})


def find_positives(bits: int, groups: int, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            block = Block(rows, bits, groups)
            vectors = unpack(planes_of(anchors.column("vector"), bits, groups))
            ids, marks, labels = (anchors.column(c).to_pylist() for c in ("anchor", "mark", "own_label"))
            of_label: dict[str, list[int]] = {}
            for i, label in enumerate(labels):
                of_label.setdefault(label, []).append(i)
            for label, members in of_label.items():
                same = np.flatnonzero(block.labels == label)
                scorer = Scores(block.planes[same])
                for start in range(0, len(members), TILE_ANCHORS):
                    tile = members[start : start + TILE_ANCHORS]
                    scores = np.ascontiguousarray(scorer.of(vectors[tile]).T)
                    for i, row in zip(tile, scores, strict=True):
                        chosen = best(row, block.others(ids[i])[same], k)
                        value = dict(zip(same[chosen].tolist(), row[chosen].tolist(), strict=True))
                        out += [(ids[i], marks[i], 0, None, None, block.ids[p], value[p]) for p in block.told(same[chosen], k)]
        return found_table(out)

    return run


def find_negatives(bits: int, groups: int, k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            block = Block(rows, bits, groups)
            vectors = unpack(planes_of(anchors.column("vector"), bits, groups))
            ids, marks, labels, positives = (anchors.column(c).to_pylist() for c in ("anchor", "mark", "own_label", "positives"))
            scorer = Scores(block.planes)
            for start in range(0, len(ids), TILE_ANCHORS):
                tile = range(start, min(len(ids), start + TILE_ANCHORS))
                scores = np.ascontiguousarray(scorer.of(vectors[tile.start : tile.stop]).T)
                for i, row in zip(tile, scores, strict=True):
                    able = block.others(ids[i]) & (block.labels != labels[i])
                    for p in positives[i]:
                        # low * p <= 100 * score <= high * p, in whole numbers.
                        least, most = -(-low * p["score"] // 100), high * p["score"] // 100
                        chosen = best(row, able & (row >= least) & (row <= most), k)
                        value = dict(zip(chosen.tolist(), row[chosen].tolist(), strict=True))
                        out += [(ids[i], marks[i], p["place"], p["id"], p["score"], block.ids[n], value[n]) for n in block.told(chosen, k)]
        return found_table(out)

    return run


def packed_rows(rows: DataFrame, scale: int, bits: int, groups: int) -> DataFrame:
    """id, label, anchor, planes of rows whose vectors are whole."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            values = np.floor(scale * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64)
            full = np.zeros((batch.num_rows, groups * 8), np.int64)
            full[np.arange(groups * 8)[None, :] < lengths[:, None]] = values
            planes = [p.tobytes() for p in pack(full, bits)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array(planes, pa.binary())], names=["id", "label", "anchor", "planes"])

    return rows.mapInArrow(run, "id long, label string, anchor boolean, planes binary")


def mine(rows: DataFrame, vec_id: Column, vector: Column, label: Column, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors. An anchor's positives are the best ``positives``
    other rows of its label. For each, the best ``negatives`` rows of other labels are given
    whose score is from ``low`` to ``high`` per cent of the positive's.
    """
    whole = rows.select(vec_id.cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("vector"), (F.coalesce(anchor, F.lit(False)) & vec_id.isNotNull()).alias("anchor"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = whole.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    sizes = whole.agg(
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"),
        F.coalesce(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double") * scale)))), F.lit(0.0)).alias("largest"),
    ).first()
    groups, bits = max(1, -(-sizes.width // 8)), int(sizes.largest + 1).bit_length() + 1
    if groups * 8 * int(sizes.largest + 1) ** 2 >= 1 << 63:
        raise ValueError(f"scores of vectors of {sizes.width} components up to {sizes.largest / scale:g} do not fit 64 bits")
    packed = packed_rows(whole, scale, bits, groups).groupBy("id", "label", "anchor", "planes").agg(F.count("*").alias("copies"))
    packed = checkpoint(packed)
    n, n_anchors = packed.agg(F.count("*"), F.count_if("anchor")).first()
    row_blocks = max(1, -(-n // block_rows))
    anchor_blocks = max(1, -(-n_anchors // block_anchors), min(SPREAD, n_anchors // LEAST))

    def block(n_blocks: int, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(n_blocks))

    def every(n_blocks: int, step: int = 1) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit((n_blocks - 1) * step), F.lit(step)))

    candidates = packed.select("id", "label", "planes", "copies", every(anchor_blocks, row_blocks).alias("at"))
    candidates = candidates.select((F.col("at") + block(row_blocks, "id", "label", "planes")).alias("cell"), "id", "label", "planes", "copies").groupBy("cell")
    mark = F.unhex(F.md5(F.concat("planes", F.encode("label", "UTF-8"))))
    chosen = packed.where("anchor").select(F.col("id").alias("anchor"), F.col("label").alias("own_label"), F.col("planes").alias("vector"), mark.alias("mark"))

    def with_rows(anchors: DataFrame, find, *columns: str) -> DataFrame:
        dealt = anchors.select("*", every(row_blocks).alias("at"))
        dealt = dealt.select((block(anchor_blocks, "anchor", "mark") * row_blocks + F.col("at")).alias("of_cell"), "anchor", "own_label", "vector", "mark", *columns)
        return dealt.groupBy("of_cell").cogroup(candidates).applyInArrow(find, FOUND)

    def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = ranked(with_rows(chosen, find_positives(bits, groups, positives)), ["anchor", "mark"], positives)
    listed = first.groupBy("anchor", "mark").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("place"), "id", "score"))).alias("positives"))
    second = with_rows(chosen.join(listed, ["anchor", "mark"]), find_negatives(bits, groups, negatives, low, high), "positives")
    out = ranked(second, ["anchor", "mark", "place"], negatives)
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def contract(embeddings: DataFrame) -> DataFrame:
    """The registered query: labels of one row in seven are wrong by one, one row in a hundred is an anchor."""
    vec_id, label = F.col("vec_id"), F.col("label")
    noisy = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(embeddings, vec_id, F.col("embedding"), noisy, vec_id % 100 == 0)
