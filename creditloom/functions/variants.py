"""JSON payloads as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

__all__ = ["unnest_json"]




def _kind(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name.startswith("STRING"), "string")
        .when(name.startswith("BOOLEAN"), "boolean").when(name.startswith("VOID") | name.isNull(), "null").otherwise("number")
    )


def unnest_json(rows: DataFrame, column: str, depth: int = 4) -> DataFrame:
    """One row per value inside a JSON text: the other columns, path, key, position, kind, value.

    Objects and arrays are taken apart level by level, ``depth`` levels at most; what is
    nested deeper stays one row with its JSON text. Paths read ``a.b[0]``. A text that is no
    JSON, or a bare scalar, has no rows; empty objects and arrays have none either.
    """
    kept = [c for c in rows.columns if c != column]
    level = rows.select(*kept, F.lit("").alias("path"), F.try_parse_json(column).alias("_value"))
    found: DataFrame | None = None
    for k in range(depth):
        inner = level.where(F.col("_value").isNotNull() & _kind(F.col("_value")).isin("object", "array")).select(*kept, "path", "_value")
        spark = rows.sparkSession
        taken = inner.lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = taken.select(*kept, F.concat("path", step).alias("path"), "key", F.col("pos").cast("int").alias("position"), F.col("value").alias("_value"))
        leaf = level if k == depth - 1 else level.where(~_kind(F.col("_value")).isin("object", "array"))
        found = leaf if found is None else found.unionByName(leaf)
    kind = _kind(F.col("_value"))
    text = F.when(kind.isin("object", "array"), F.to_json("_value")).otherwise(F.try_variant_get("_value", "$", "string"))
    return found.select(*kept, "path", "key", "position", kind.alias("kind"), text.alias("value"))
