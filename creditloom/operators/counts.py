"""Distinct counts that add up: bitmaps over dense numbers, kept per key and word.

A word holds 64 numbers in one bigint, so words are grouped in place, map-side, and a key
never has more rows than numbers: sparse numbers cost a short row each, dense ones an eighth
of a byte beside their key. The words of two snapshots unite bit by bit, so a union is counted
without the rows behind it. No key's numbers meet in one place: words stay rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.dump import union_all


def distinct_bitmaps(rows: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """keys, word, bits: the numbers met with each key; nulls count nothing."""
    number = number.cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(64)).cast("int"))
    known = rows.where(number.isNotNull())
    return known.groupBy(*keys, F.shiftright(number, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def unite(*snapshots: DataFrame) -> DataFrame:
    """The bitmaps of all snapshots together."""
    keys = [c for c in snapshots[0].columns if c != "bits"]
    return union_all(list(snapshots)).groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def common(first: DataFrame, second: DataFrame) -> DataFrame:
    """The bitmaps of what both snapshots hold."""
    keys = [c for c in first.columns if c != "bits"]
    both = union_all([first, second]).groupBy(*keys).agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
    return both.where("_n = 2").drop("_n")


def distinct_counts(bitmaps: DataFrame, keys: list[str], name: str = "distinct") -> DataFrame:
    """How many different numbers each key has."""
    counted = bitmaps.groupBy(*keys) if keys else bitmaps.groupBy()
    return counted.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias(name))
