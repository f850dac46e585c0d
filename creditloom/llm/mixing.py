"""Mixing sources to target weights.

Words are summed per source. Targets share all words by the sources' weights; a target stops
at ``cap`` times what its source has, and the excess goes to the other sources by weight
until none is above. A source's rate is its target over its words; a document is emitted
floor(rate) times, plus once more if a draw on its id falls below the fraction.

Only the table of sources (one row each) is laid out in one task. Documents never shuffle
while that table has fewer rows than ``BROADCAST_SOURCES``, which is counted first; beyond,
Spark joins by source and AQE splits a hot one.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a
source without words has target 0 and its documents are taken 0 times; an empty table gives
no rows. Rows that repeat a doc_id draw the same number. Columns beside doc_id, text and
source are carried by ``emit`` and never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, unit_draw, word_count

CAP = 3
BROADCAST_SOURCES = 100_000
SEED = "mix:"


def source_targets(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target: one row per source."""
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    # One row per source from here on. Strings order by code point; nulls come last.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.select("source", "source_size", ((F.row_number().over(named) - 1) % 3 + 1).alias("weight"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    leveled = weighed.select(
        "source", "source_size", "weight",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), zero)).cast("double")
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)).cast("double")).alias("level"),
    )
    # Sources fill up in the order of their caps per weight. The level of the first that
    # stays below its cap holds for all after it.
    below = F.col("source_size").cast("double") * cap / F.col("weight") >= F.col("level")
    common = F.max(F.when(below, F.col("level"))).over(everything)
    return leveled.select("source", "source_size", F.when(below, common * F.col("weight")).otherwise(F.col("source_size").cast("double") * cap).alias("target"))


def copies(target, size, doc_id, cap: int = CAP):
    """How often a document is emitted."""
    rate = F.when(size > 0, F.least(target / size, F.lit(float(cap)))).otherwise(F.lit(0.0))
    return F.floor(rate) + (unit_draw(doc_id, SEED) < rate - F.floor(rate)).cast("long")


def _with_targets(rows: DataFrame, docs: DataFrame, cap: int, broadcast_sources: int) -> DataFrame:
    targets = checkpoint(source_targets(docs, cap).withColumnRenamed("source", "mix_source"))
    if targets.count() <= broadcast_sources:
        targets = F.broadcast(targets)
    return rows.join(targets, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")


def mix(docs: DataFrame, cap: int = CAP, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    Targets are broadcast up to ``broadcast_sources`` sources and joined by a shuffle beyond.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    joined = _with_targets(rows, docs.select("text", "source"), cap, broadcast_sources)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("target"), F.col("source_size"), F.col("doc_id"), cap)).alias("taken"))


def emit(docs: DataFrame, cap: int = CAP, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source")
    joined = _with_targets(rows, docs.select("text", "source"), cap, broadcast_sources)
    times = copies(F.col("target"), F.col("source_size"), F.col("doc_id"), cap)
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy")).select("row.*")
