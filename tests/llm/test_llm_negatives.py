"""Hard negatives against all scores, plainly computed."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, id long"


def plain(rows, scale=256, positives=5, kept=10, low=30, high=90):
    able = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            able.append((i, [math.floor(scale * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out, seen = [], set()
    for i, v, label in able:
        if i is None or i % 100 or (i, tuple(v), label) in seen:
            continue
        seen.add((i, tuple(v), label))
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, other) for j, w, other in able if j != i]
        for p in sorted(s[:3] for s in scored if s[3] == label)[:positives]:
            near = sorted(s[:3] for s in scored if s[3] != label and -low * p[0] <= -100 * s[0] <= -high * p[0])[:kept]
            for rank, s in enumerate(near, 1):
                out.append((i, None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]))
    return sorted(map(str, out))


def mined(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], SCHEMA).repartition(3)
    vec_id, label = F.col("vec_id"), F.col("label")
    noisy = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    found = negatives.mine(frame, vec_id, F.col("embedding"), noisy, vec_id % 100 == 0, **sizes)
    return sorted(str(tuple(r)) for r in found.collect())


def vectors(n, dims, seed, labels=4, spread=1.0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0.2, spread) for _ in range(dims)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, spread) for c in centers[i % labels]], i % labels) for i in range(n)]


@pytest.mark.parametrize(("dims", "sizes"), [(11, {}), (8, {"block_rows": 60, "block_anchors": 2}), (64, {"block_rows": 200})])
def test_equals_all_scores(spark, dims, sizes):
    rows = vectors(730, dims, dims)
    got = mined(spark, rows, **sizes)
    assert got and got == plain(rows)


def test_odd_rows(spark):
    rows = vectors(420, 5, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (1000, [1.0, None], 1), (1100, [nan], 2), (1200, [inf, 1.0], 2), (1300, [1.0], None), (1400, [], 1), (-100, [0.5, 1.5], 3), (1500, [0.25], 9)]
    rows += [(None, list(rows[4][1]), 1), (None, list(rows[4][1]), 1)]
    rows += [(300, list(rows[300][1]), rows[300][2])] * 3 + [(41, list(rows[41][1]), rows[41][2])] * 20
    rows += [(k, list(rows[8][1]), k % 4) for k in range(2000, 2060)]
    got = mined(spark, rows, block_rows=100, block_anchors=2)
    assert got and got == plain(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components(spark):
    rows = [(i, [x * 1e5 for x in v], label) for i, v, label in vectors(230, 9, 4)]
    got = mined(spark, rows)
    assert got and got == plain(rows)
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(0, [1e12], 1)])


def test_tables_and_planes():
    rng = np.random.default_rng(2)
    for bits, kind in ((9, np.int16), (20, np.int32), (30, np.int64)):
        rows = rng.integers(-(1 << bits - 1), 1 << bits - 1, (50, 24))
        planes = negatives.pack(rows, bits)
        assert np.array_equal(negatives.unpack(planes), rows)
        anchors = rng.integers(-(1 << min(bits, 20) - 1), 1 << min(bits, 20) - 1, (7, 24))
        assert np.array_equal(negatives.Scores(planes).of(anchors), rows @ anchors.T)
        sums = negatives.subset_sums(anchors, np.int64)
        assert sums[1, 0b10000101, 3] == anchors[3, [8, 10, 15]].sum()


def test_equal_rows_stay_out_of_one_block(spark):
    """A row repeated many times is one entry with a count."""
    copies = spark.range(20000).select(F.lit(5).cast("long").alias("vec_id"), F.array(F.lit(0.5).cast("float"), F.lit(0.5).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    frame = copies.unionByName(spark.createDataFrame([(100, [0.5, 0.5], 2), (1, [0.9, 0.9], 2)], "vec_id long, embedding array<float>, label int"))
    found = negatives.mine(frame, F.col("vec_id"), F.col("embedding"), F.col("label"), F.col("vec_id") == 100)
    want = plain([(5, [0.5, 0.5], 1)] * 20 + [(100, [0.5, 0.5], 2), (1, [0.9, 0.9], 2)])
    got = sorted(str(tuple(r)) for r in found.collect())
    assert len(got) == 10 and got == want
