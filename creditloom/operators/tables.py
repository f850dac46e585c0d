"""Keyed upserts and small set operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` insert or replace rows of ``old`` with the same key, by one full join.

    Columns named in ``keep`` retain the old value on replacement, as a created_at
    does. ``new`` must be unique on its keys. Upserting twice changes nothing.
    """
    before = old.select(*[F.col(c).alias(f"_old_{c}") for c in old.columns], F.lit(True).alias("_was"))
    after = new.select("*", F.lit(True).alias("_is"))
    same = [after[k] == before[f"_old_{k}"] for k in keys]
    joined = before.join(after, same, "full")

    def value(c: str) -> Column:
        ours = F.col(c) if c in new.columns else F.lit(None)
        theirs = F.col(f"_old_{c}") if c in old.columns else F.lit(None)
        return F.when(F.col("_is"), F.coalesce(theirs, ours) if c in keep else ours).otherwise(theirs).alias(c)

    return joined.select(*map(value, [*old.columns, *(c for c in new.columns if c not in old.columns)]))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert rows whose key is not there yet; the others are ignored."""
    return old.unionByName(fresh(new, old, keys), allowMissingColumns=True)


def replace_children(old: DataFrame, parents: DataFrame, new: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Drop all child rows of the given parents and put the new ones in."""
    return old.join(parents.select(*parent_keys).distinct(), parent_keys, "left_anti").unionByName(new, allowMissingColumns=True)


def fresh(incoming: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct incoming keys that are not present."""
    return incoming.dropDuplicates(keys).join(present.select(*keys), keys, "left_anti")


def dangling(rows: DataFrame, parents: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Non-null references without a parent."""
    known = parents.select(F.col(parent_column).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
