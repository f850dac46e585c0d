"""N-gram Jaccard self join by a token-group matrix.

A document's set is its distinct shingles of ``SHINGLE`` words. Two documents link when their
sets' Jaccard index is at least ``PERCENT`` hundredths; the result is each document's component.

1. Equal sets are one class; from here on a class is its first document.
2. A set that links needs that share of its shingles in some other document. ``blocks`` counts
   the holders of every shingle, and sets that fall short are out: nearly all of a corpus.
3. What is left is partitioned into groups of similar sets: by the least shingle hash a set
   shares with others, in parts of about ``PART_TOKENS`` shingles. Inside a part all pairs are
   compared by one product of its set-by-shingle matrix with itself.
4. Each part keeps its largest component as one group and the rest as another, with the union
   of the group's shingles. The token-group matrix has a row for every (shingle, group) where
   the shingle is in the prefix of a member: the rarest shingles, so many that two linked sets
   must share one. Groups meet where they share a row, except where both are whole components
   already known to be one.
5. Opening a pair of groups first bounds each member's overlap by the other group's union, and
   compares only members above the bound, again by one matrix product.
6. Links within and between parts are joined to components.

Every link between different sets lies inside a part or is found when two groups are opened,
so no component is cut; ``match`` keeps only links enough for components. ``count_links`` also
opens every group with itself and all groups that meet, and so has every link of every set:
``n_links`` is exact, and ``set_pairs`` lists the pairs. Its work grows with the links, which in
a group of near copies is the square of its sets. Shingles are told apart by 64
bits when counted and by 48 bits when two groups are compared.

Edge cases: words are runs without ASCII white space, A-Z lower-cased; a text with fewer words
than a shingle is one shingle; a null text or one without words has an empty set and is its own
component; rows that repeat a doc_id share its component only through equal or linked sets;
null ids never name a component (a component of null ids alone is null). An empty table gives
no rows. Other columns are carried by ``keep_one`` and may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Words
from .blocks import ANSWERS, BLOCK_BYTES, BUCKET_KEYS, KEYS, U, Distinct, Texts, count_answer, keys_table, lay_out, mix, size_of
from .common import checkpoint
from .graph import components

SHINGLE = 5
PERCENT = 75
PART_TOKENS = 1 << 16
KEY_BYTES = 4
TOKEN_BYTES = 6

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

SETS = "set_id binary, id long, n_shingles long, tokens binary, prefix array<long>, home long"
GROUPS = "group long, part long, home long, bulk boolean, set_ids binary, sizes binary, tokens binary, union array<long>, star binary, lead binary, weights binary"
LINKS = "a binary, b binary"
COUNTS = "a binary, n long"


def needed(n: int) -> int:
    """Least overlap of a set of n with any set it links to."""
    return -(-PERCENT * n // 100)


def pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.reshape(-1).view("<u8")


class Sets:
    """The shingle sets of one block, and its distinct shingles."""

    def __init__(self, block: pa.Table, buckets: int) -> None:
        self.texts = texts = Texts(block)
        texts.bytes = np.frombuffer(texts.bytes.tobytes().translate(_LOWER), np.uint8)
        words = Words(texts)
        rolling = words.rolling(0)
        at = np.flatnonzero(words.left >= SHINGLE)
        short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
        hashes = np.r_[rolling.spans(at, at + SHINGLE), rolling.spans(words.first[short], words.first[short] + words.counts[short])]
        doc = np.r_[words.doc[at], short]
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        fresh = np.r_[np.ones(min(1, len(doc)), bool), (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]
        hashes, doc = hashes[fresh], doc[fresh]
        self.sizes = np.bincount(doc, minlength=len(texts.raw))
        self.cuts = np.r_[0, np.cumsum(self.sizes)]
        self.hashes = hashes
        self.ids = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        # The first of equal sets in the block stands for all.
        seen: set[bytes] = set()
        self.lead = np.array([i is not None and i not in seen and not seen.add(i) for i in self.ids], bool)
        mine = np.repeat(self.lead, self.sizes)
        spread = (mix(hashes ^ U(0x5851F42D4C957F2D)) % U(buckets)).astype(np.int64)
        self.distinct = Distinct(hashes[mine] >> U(64 - 8 * KEY_BYTES), spread[mine])

    def judged(self, answers: dict[int, bytes]) -> pa.Table:
        """One row per document; tokens, prefix and home only where a link is possible."""
        holders = np.ones(len(self.hashes), np.int64)
        holders[np.repeat(self.lead, self.sizes)] = self.distinct.counted(answers)[self.distinct.of]
        tokens, prefixes, homes = [], [], []
        for d, (a, b) in enumerate(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)):
            n = b - a
            shared = holders[a:b] > 1
            if not self.lead[d] or shared.sum() < needed(n):
                tokens.append(None), prefixes.append(None), homes.append(None)
                continue
            own = self.hashes[a:b]
            # Rarest first, then by hash: one order for all documents.
            first = np.lexsort((own, holders[a:b]))[: n - needed(n) + 1]
            tokens.append(pack(np.sort(own & U((1 << 8 * TOKEN_BYTES) - 1))))
            prefixes.append(own[first][shared[first]].view(np.int64))
            homes.append(int(own[shared].min().view(np.int64)))
        return pa.table({
            "set_id": pa.array(self.ids, pa.binary()), "id": pa.array(self.texts.ids, pa.int64()), "n_shingles": pa.array(self.sizes, pa.int64()),
            "tokens": pa.array(tokens, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "home": pa.array(homes, pa.int64()),
        })


def overlaps(left: list[np.ndarray], right: list[np.ndarray], universe: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sizes of all intersections within the universe, by products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.searchsorted(universe, tokens)
        hit = (at < len(universe)) & (universe[np.minimum(at, len(universe) - 1)] == tokens)
        order = np.argsort(at[hit], kind="stable")
        return rows[hit][order], at[hit][order]

    if not len(universe):
        return out
    (rows_a, at_a), (rows_b, at_b) = entries(left), entries(right)
    for start in range(0, len(universe), step):
        matrices = []
        for rows, at, n in ((rows_a, at_a, len(left)), (rows_b, at_b, len(right))):
            span = slice(*np.searchsorted(at, (start, start + step)))
            matrix = np.zeros((n, step), np.float32)
            matrix[rows[span], at[span] - start] = 1
            matrices.append(matrix)
        out += matrices[0] @ matrices[1].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    common = overlaps(left, right, universe)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return 100 * common >= PERCENT * (sizes - common)


class Forest:
    """Union-find over a few sets; the least index is the root."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = sorted((self.find(i), self.find(j)))
        self.root[j] = i
        return i != j


def split_part(table: pa.Table) -> pa.Table:
    """A part's sets as two groups: the largest component found inside, and the rest."""
    rows = sorted(zip(table.column("set_id").to_pylist(), table.column("tokens").to_pylist(), table.column("prefix").to_pylist(), table.column("n_rows").to_pylist(), strict=True))
    sets = [unpack(row[1]) for row in rows]
    tokens, times = np.unique(np.concatenate(sets), return_counts=True)
    links = linked(sets, sets, tokens[times > 1])
    forest = Forest(len(rows))
    for i, row in enumerate(links):
        for j in np.flatnonzero(row[:i]).tolist():
            forest.join(i, j)
    roots = np.array([forest.find(i) for i in range(len(rows))])
    largest = np.bincount(roots).argmax()
    home, part = table.column("home")[0].as_py(), table.column("part")[0].as_py()
    out = []
    for bulk in (True, False):
        members = [i for i in range(len(rows)) if (roots[i] == largest) == bulk]
        if members:
            out.append((
                xxhash.xxh3_64_intdigest(rows[members[0]][0]) - (1 << 63), part, home, bulk,
                b"".join(rows[i][0] for i in members), np.array([len(sets[i]) for i in members], "<i8").tobytes(), b"".join(rows[i][1] for i in members),
                np.unique(np.concatenate([np.asarray(rows[i][2], np.int64) for i in members])), b"".join(rows[roots[i]][0] for i in members), rows[members[0]][1],
                np.array([rows[i][3] for i in members], "<i8").tobytes(),
            ))
    names = [f.split()[0] for f in GROUPS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)})


def members(set_ids: bytes, sizes: bytes, tokens: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    cuts = np.r_[0, np.cumsum(np.frombuffer(sizes, "<i8"))]
    flat = unpack(tokens)
    return [set_ids[i : i + 16] for i in range(0, len(set_ids), 16)], [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def compared(left: tuple, right: tuple) -> tuple[list[bytes], list[bytes], np.ndarray, list[int], list[int]]:
    """Which members of two groups link, without those that can't; and the places of the members."""
    (ids_a, sets_a), (ids_b, sets_b) = members(*left), members(*right)
    union_a, union_b = np.unique(np.concatenate(sets_a)), np.unique(np.concatenate(sets_b))
    universe = np.intersect1d(union_a, union_b, assume_unique=True)

    def above(sets: list[np.ndarray]) -> list[int]:
        """Members whose overlap with the other group's union reaches what a link needs."""
        return [i for i, s in enumerate(sets) if np.isin(s, universe, assume_unique=True).sum() >= needed(len(s))]

    rows, columns = above(sets_a), above(sets_b)
    links = linked([sets_a[i] for i in rows], [sets_b[j] for j in columns], universe) if rows and columns else np.zeros((len(rows), len(columns)), bool)
    return [ids_a[i] for i in rows], [ids_b[j] for j in columns], links, rows, columns


def open_groups(left: tuple, right: tuple) -> list[tuple[bytes, bytes]]:
    """Links between two groups that join something new, in both groups' members."""
    rows, columns, links, *_ = compared(left, right)
    forest, out = Forest(len(rows) + len(columns)), []
    for i, row in enumerate(links):
        for j in np.flatnonzero(row).tolist():
            if forest.join(i, len(rows) + j):
                out.append((rows[i], columns[j]))
    return out


def _opened(batches):
    """Of every pair of groups: members, links, and how many rows have each member's set."""
    names = ("group_a", "group_b", "set_ids", "sizes", "tokens", "set_ids_b", "sizes_b", "tokens_b", "weights", "weights_b")
    for batch in batches:
        for group_a, group_b, *row, weights_a, weights_b in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            ids_a, ids_b, links, at_a, at_b = compared(row[:3], row[3:])
            if group_a == group_b:
                np.fill_diagonal(links, False)
            yield group_a == group_b, ids_a, ids_b, links, np.frombuffer(weights_a, "<i8")[at_a], np.frombuffer(weights_b, "<i8")[at_b]


def _count(batches):
    for same, ids_a, ids_b, links, weights_a, weights_b in _opened(batches):
        sides = [(ids_a, links @ weights_b)] + ([] if same else [(ids_b, weights_a @ links)])
        for ids, n in sides:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(n, pa.int64())], names=["a", "n"])


def _pairs(batches):
    for same, ids_a, ids_b, links, _, _ in _opened(batches):
        at_a, at_b = np.nonzero(np.triu(links) if same else links)
        ends = [sorted((ids_a[i], ids_b[j])) for i, j in zip(at_a.tolist(), at_b.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _verify(batches):
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("set_ids", "sizes", "tokens", "set_ids_b", "sizes_b", "tokens_b")]
        found = [link for row in zip(*columns, strict=True) for link in open_groups(row[:3], row[3:])]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def shingle_sets(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``SETS``: one row per document."""
    n_bytes = size_of(docs)
    laid = lay_out(docs, n_bytes, ["doc_id"], block_bytes)
    buckets = max(1, n_bytes // (6 * bucket_keys))

    def send(block: pa.Table) -> pa.Table:
        distinct = Sets(block, buckets).distinct
        return keys_table(distinct.sent(block.column("block")[0].as_py(), np.minimum(distinct.counts, 255).astype(np.uint8), width=KEY_BYTES))

    def judge(block: pa.Table, answers: pa.Table) -> pa.Table:
        told = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        return Sets(block, buckets).judged(told)

    sent = laid.groupBy("block").applyInArrow(send, KEYS)
    counted = sent.groupBy("bucket").applyInArrow(count_answer(KEY_BYTES), ANSWERS)
    return laid.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(judge, SETS)


def grouped(sets: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``GROUPS``: the sets that may link, in parts of a home."""
    able = sets.where("tokens IS NOT NULL").select("set_id", "n_shingles", "tokens", "prefix", "home", F.coalesce("id", F.lit((1 << 63) - 1)).alias("first_id"))
    # Of the blocks' first documents, the class's own; equal ids leave equal rows. The class's
    # least id may be of no such document, as null ids come first in a block.
    firsts = able.groupBy(F.col("set_id").alias("first_set")).agg(F.min("first_id").alias("least_first"))
    able = able.join(firsts, (F.col("set_id") == F.col("first_set")) & (F.col("first_id") == F.col("least_first")), "left_semi").dropDuplicates(["set_id"])
    able = able.join(sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.count("*").alias("n_rows")), "set_id")
    # Written, so that Spark can split a home with very many sets in the join.
    parts = checkpoint(able.groupBy(F.col("home").alias("of")).agg(F.ceil(F.sum("n_shingles") / part_tokens).alias("parts")))
    placed = able.join(parts, F.col("home") == F.col("of")).select("set_id", "tokens", "prefix", "n_rows", "home", F.pmod(F.xxhash64("set_id"), F.col("parts")).alias("part"))
    return checkpoint(placed.groupBy("home", "part").applyInArrow(split_part, GROUPS))


def joined_bodies(met: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of every pair of groups in ``met`` (group_a, group_b)."""
    names = ("set_ids", "sizes", "tokens", "weights")
    bodies = groups.select("group", *names)
    pairs = met.join(bodies.withColumnRenamed("group", "group_a"), "group_a").join(bodies.select(F.col("group").alias("group_b"), *[F.col(c).alias(f"{c}_b") for c in names]), "group_b")
    return pairs.select("group_a", "group_b", *names, *[f"{c}_b" for c in names])


def group_links(groups: DataFrame) -> DataFrame:
    """``LINKS`` that connect all linked sets: enough for components, but not all links, and the
    stars name members of one component that need not link themselves."""
    star = groups.select(F.explode(F.sequence(F.lit(0), (F.length("set_ids") / 16 - 1).cast("int"))).alias("k"), "set_ids", "star")
    star = star.select(F.expr("substring(set_ids, k * 16 + 1, 16)").alias("a"), F.expr("substring(star, k * 16 + 1, 16)").alias("b")).where("a <> b")
    # The largest components of a home's parts are one if their first sets link to that of part 0.
    bulks = groups.where("bulk").select("home", "part", F.expr("substring(set_ids, 1, 16)").alias("set_ids"), F.expr("substring(sizes, 1, 8)").alias("sizes"), F.col("lead").alias("tokens"))
    zero = bulks.where("part = 0").select(F.col("home").alias("home_b"), *[F.col(c).alias(f"{c}_b") for c in ("set_ids", "sizes", "tokens")])
    bridges = checkpoint(bulks.where("part > 0").join(zero, F.col("home") == F.col("home_b")).mapInArrow(_verify, LINKS))
    # Bulks known to be one component carry the same name.
    known = groups.where("bulk").select("group", "home", F.expr("substring(set_ids, 1, 16)").alias("lead_id")).join(bridges.select(F.col("a").alias("lead_id"), F.col("b").alias("zero_id")), "lead_id", "left")
    named = known.select("group", F.coalesce("zero_id", "lead_id").alias("name"))
    rows = groups.select("group", "home", "part", F.explode("union").alias("token")).join(named, "group", "left")
    a, b = (rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("group", "home", "part", "name")]) for s in "ab")
    met = a.join(b, "token").where("group_a < group_b AND NOT (home_a = home_b AND part_a = part_b) AND coalesce(name_a <> name_b, true)").select("group_a", "group_b").distinct()
    between = joined_bodies(met, groups).mapInArrow(_verify, LINKS)
    return star.union(bridges).union(between)


def meetings(groups: DataFrame) -> DataFrame:
    """Bodies of all pairs of groups that may hold a link; every link is in just one of them.

    A group is opened with itself and with every group that shares a row of the token-group
    matrix, whatever is known of their components.
    """
    rows = groups.select("group", "home", "part", F.explode("union").alias("token"))
    a, b = (rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("group", "home", "part")]) for s in "ab")
    met = a.join(b, "token").where("group_a < group_b AND NOT (home_a = home_b AND part_a = part_b)").select("group_a", "group_b").distinct()
    own = groups.select(F.col("group").alias("group_a"), F.col("group").alias("group_b"))
    return joined_bodies(met.union(own), groups)


def match(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets = checkpoint(shingle_sets(docs, block_bytes, bucket_keys))
    return labelled(sets, grouped(sets, part_tokens)).select("doc_id", "n_shingles", "component_id")


def labelled(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and set_id of every document."""
    roots = components(group_links(groups)).withColumnRenamed("root", "found_root")
    # Classes first: a set that a third of all documents share is one row here.
    classes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("id").alias("least_id"))
    keyed = classes.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least_id", F.coalesce("found_root", "set_id").alias("key"))
    lowest = keyed.groupBy("key").agg(F.min("least_id").alias("component_id"))
    # Written, so that the last join is between plain rows and Spark can split a hot set.
    named = checkpoint(keyed.join(lowest, "key").select(F.col("set_id").alias("of"), "component_id"))
    rows = sets.select("set_id", "id", "n_shingles").join(named, F.col("set_id") == F.col("of"), "left")
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "set_id")


def count_links(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: the columns of ``match``, and to how many other
    rows a document links, those with an equal set among them."""
    sets = checkpoint(shingle_sets(docs, block_bytes, bucket_keys))
    groups = grouped(sets, part_tokens)
    found = meetings(groups).mapInArrow(_count, COUNTS).groupBy("a").agg(F.sum("n").alias("linked"))
    sizes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.count("*").alias("n_rows"))
    counted = sizes.join(found, F.col("set_id") == F.col("a"), "left").select(F.col("set_id").alias("of"), (F.col("n_rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    rows = labelled(sets, groups).join(checkpoint(counted), F.col("set_id") == F.col("of"), "left")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def set_pairs(sets: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``LINKS`` of all pairs of different linked sets, a < b. The set_id of ``sets`` (as made by
    ``shingle_sets``) names the documents of a set; rows of one set link too."""
    return meetings(grouped(sets, part_tokens)).mapInArrow(_pairs, LINKS)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose doc_id isn't its component's least.

    A repeated doc_id stays if one of its rows would.
    """
    found = match(docs).where("doc_id IS NOT NULL")
    gone = found.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("stays")).where("stays = 0")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
