"""Table sink with counts and digest, manifests, and the sharded document export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..config import DEFAULT, SERVING_SCHEMA, Policy
from ..functions import content_digest, packed_id, shard_key, unpacked_id
from ..schemas import MANIFEST, SHARDS

_LANES = 8


@dataclass(frozen=True)
class TableStats:
    rows: int
    bytes: int
    digest: str
    #: Sums of the row digests, from which a change goes on without a scan.
    lanes: tuple[str, ...] = ()


def _digest_parts(df: DataFrame) -> list[Column]:
    """Row count, JSON bytes, and eight 32-bit lanes of the row digests, summed.

    Adding up row digests gives a multiset hash: it does not depend on row order
    or partitioning, combines map-side, and never gathers rows.
    """
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    digest = content_digest(*df.columns)
    lanes = [
        F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"lane{i}")
        for i in range(_LANES)
    ]
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes"), *lanes]


def _finish(values: dict) -> TableStats:
    import hashlib

    lanes = tuple(str(int(values[f"lane{i}"] or 0)) for i in range(_LANES))
    digest = hashlib.sha256(f"{values['rows']}:{':'.join(lanes)}".encode()).hexdigest()
    return TableStats(int(values["rows"]), int(values["bytes"] or 0), digest, lanes)


def table_stats_frame(df: DataFrame) -> DataFrame:
    """One row: rows, bytes and digest lanes."""
    return df.agg(*_digest_parts(df))


def table_stats(df: DataFrame) -> TableStats:
    return _finish(table_stats_frame(df).first().asDict())


def stats_after(before: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The row of ``table_stats_frame`` after a change, without the rows that stay.

    ``removed`` holds the rows as they were, ``added`` as they are now; a replaced row is in
    both. Sums of digests are taken back and added to, so only changed rows are read.
    """
    names = ["rows", "bytes", *(f"lane{i}" for i in range(_LANES))]

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*[(F.coalesce(F.col(n), F.lit(0)).cast("decimal(38,0)") * sign).cast("decimal(38,0)").alias(n) for n in names])

    parts = signed(before, 1).unionByName(signed(table_stats_frame(removed), -1)).unionByName(signed(table_stats_frame(added), 1))
    return parts.agg(*[F.sum(n).cast("bigint" if n in ("rows", "bytes") else "decimal(38,0)").alias(n) for n in names])


def change_of(old: DataFrame, new: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(removed, added) of an upsert of ``new`` into ``old`` and a deletion of the ``deleted`` keys after it."""
    gone = new.select(*keys) if deleted is None else new.select(*keys).unionByName(deleted.select(*keys))
    removed = old.join(gone.distinct(), keys, "left_semi").select(*old.columns)
    added = new if deleted is None else new.join(deleted.select(*keys).distinct(), keys, "left_anti")
    return removed, added.select(*old.columns)


def table_stats_after(spark: SparkSession, before: TableStats, removed: DataFrame, added: DataFrame) -> TableStats:
    """A table's counts and digest after a change, from those before it, as a manifest keeps them."""
    fields = ["rows", "bytes", *(f"lane{i}" for i in range(_LANES))]
    values = [F.lit(v).cast("decimal(38,0)").alias(n) for n, v in zip(fields, [before.rows, before.bytes, *before.lanes], strict=True)]
    return _finish(stats_after(spark.range(1).select(*values), removed, added).first().asDict())


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> TableStats:
    """Write Parquet once; counts and digest are observed during that same pass."""
    seen = Observation()
    watched = df.observe(seen, *_digest_parts(df))
    watched.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return _finish(seen.get)


def manifest_hash(tables: dict[str, TableStats]) -> str:
    """SHA-256 over (name, digest) pairs in name order."""
    import hashlib

    out = hashlib.sha256()
    for name in sorted(tables):
        out.update(name.encode())
        out.update(tables[name].digest.encode())
    return out.hexdigest()


def write_manifest(
    spark: SparkSession,
    path: str,
    schema_version: str,
    snapshot_version: str,
    tables: dict[str, TableStats],
    generated_at: str,
    parent_hash: str | None = None,
    counters: dict[str, int] | None = None,
    **texts: str,
) -> str:
    """One-row manifest; refuses an empty version and an existing target. Returns its hash."""
    if not snapshot_version.strip():
        raise ValueError("a snapshot version is required")
    digest = manifest_hash(tables)
    counters = counters or {}
    row = {
        "schema_version": schema_version,
        "snapshot_version": snapshot_version,
        "generated_at": generated_at,
        "parent_hash": parent_hash,
        "recording_count": counters.get("recording_count"),
        "credit_count": counters.get("credit_count"),
        "manifest_hash": digest,
        "tables": {name: (s.rows, s.bytes, s.digest, list(s.lanes)) for name, s in tables.items()},
        "counters": counters,
        **texts,
    }
    schema = T.StructType.fromDDL(MANIFEST)
    spark.createDataFrame([tuple(row.get(name) for name in schema.names)], schema).coalesce(1).write.mode("errorifexists").json(path)
    return digest


def manifest_gate(manifests: DataFrame, schema_version: str, snapshot_version: str) -> DataFrame:
    """Manifests with the fault that keeps each from being used; null for none."""
    fault = F.when(
        ~F.col("schema_version").eqNullSafe(schema_version), F.concat(F.lit("unsupported schema: "), F.coalesce("schema_version", F.lit("none")))
    ).when(
        ~F.col("snapshot_version").eqNullSafe(snapshot_version),
        F.concat(F.lit("snapshot mismatch: found "), F.coalesce("snapshot_version", F.lit("none")), F.lit(f", requested {snapshot_version}")),
    )
    return manifests.withColumn("fault", fault)


def read_manifest(spark: SparkSession, path: str, schema_version: str, snapshot_version: str) -> dict:
    """The manifest, or an error when its schema or snapshot is another one."""
    manifests = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    row = manifest_gate(manifests, schema_version, snapshot_version).first()
    if row is None:
        raise ValueError(f"no manifest in {path}")
    if row["fault"] is not None:
        raise ValueError(row["fault"])
    return row.asDict(recursive=True)


def manifest_tables(manifest: dict) -> dict[str, TableStats]:
    """The tables of a manifest that was read, to go on from."""
    return {name: TableStats(t["rows"], t["bytes"], t["digest"], tuple(t["lanes"] or ())) for name, t in (manifest["tables"] or {}).items()}


# Map column of each shard kind.
_MAPS = {"recording": "records", "track": "aliases", "artist": "artists"}


def shard_documents(rows: DataFrame, kind: str, snapshot_version: str, width: int, policy: Policy = DEFAULT) -> DataFrame:
    """Keyed rows (key, value) to documents per hex prefix, in numbered parts.

    A document is a unit readers load whole. The flat rows are sized first; a shard above
    the size of one part is dealt out to as many parts as it needs, by key, before any row
    is gathered. No shard is too large. Aliases, whose keys and values both are ids, are gathered packed.
    """
    sized = rows.select(
        shard_key(F.col("key"), width).alias("shard"), "key", "value",
        F.octet_length(F.to_json(F.struct("key", "value"))).cast("bigint").alias("_bytes"),
    )
    totals = sized.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("_bytes") / F.lit(policy.shard_part_bytes))).cast("bigint").alias("parts"))
    placed = sized.drop("_bytes").join(totals, "shard").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    if kind == "track":
        placed = placed.select("shard", "part", "parts", packed_id(F.col("key")).alias("key"), packed_id(F.col("value")).alias("value"))
        gathered = F.transform(F.collect_list(F.struct("key", "value")), lambda e: F.struct(unpacked_id(e["key"]).alias("key"), unpacked_id(e["value"]).alias("value")))
    else:
        gathered = F.collect_list(F.struct("key", "value"))
    entries = F.array_sort(gathered)
    return placed.groupBy("shard", "part", "parts").agg(F.map_from_entries(entries).alias(_MAPS[kind])).select(
        F.lit(SERVING_SCHEMA).alias("schema_version"), F.lit(snapshot_version).alias("snapshot_version"), "shard", "part", "parts", _MAPS[kind]
    )


def write_shards(documents: DataFrame, path: str) -> None:
    """Gzip JSON documents, one line each, under ``key=<shard>`` folders; parts spread over tasks."""
    (
        documents.withColumn("key", F.col("shard"))
        .repartition("key", "part")
        .write.mode("errorifexists")
        .partitionBy("key")
        .option("compression", "gzip")
        .json(path)
    )


def _valid_claim(c: Column) -> Column:
    return F.coalesce(
        c["instrument_name"].isNotNull()
        & c["scope"].isin("recording", "track", "release")
        & c["relation_type"].isNotNull()
        & c["production_method"].isNotNull()
        & (c["credit_count"] > 0)
        & (c["performer_count"] >= 0),
        F.lit(False),
    )


def _valid_entry(c: Column) -> Column:
    return F.coalesce(
        c["instrument_mbid"].isNotNull()
        & c["instrument_name"].isNotNull()
        & (c["distinct_recordings"] >= 0)
        & (c["documented_recordings"] >= 0)
        & c["prevalence"].between(0.0, 1.0)
        & c["qualifying"].isNotNull(),
        F.lit(False),
    )


def valid_value(kind: str, value: Column) -> Column:
    """Row validator of a shard entry."""
    if kind == "track":
        return value.isNotNull()
    if kind == "recording":
        rows, check, key = value["claims"], _valid_claim, value["recording_mbid"]
    else:
        rows, check, key = value["entries"], _valid_entry, value["artist_mbid"]
    return F.coalesce(key.isNotNull() & rows.isNotNull() & F.forall(rows, check), F.lit(False))


def open_documents(docs: DataFrame, kind: str, snapshot_version: str) -> DataFrame:
    """(key, value) rows of parsed documents; ``_folder`` names the shard they were found under.

    A document of another schema, snapshot or folder, or with an invalid row, fails the read.
    Documents of any size are read.
    """
    fault = (
        F.when(~F.col("schema_version").eqNullSafe(SERVING_SCHEMA), "unsupported schema")
        .when(~F.col("snapshot_version").eqNullSafe(snapshot_version), "snapshot mismatch")
        .when(~F.col("shard").eqNullSafe(F.col("_folder")), "shard name mismatch")
        .when(F.col(_MAPS[kind]).isNull(), "no map of rows")
    )
    label = F.concat_ws(": ", fault, F.col("_folder"))
    entries = F.map_entries(F.when(fault.isNull(), F.col(_MAPS[kind])).otherwise(F.raise_error(label).cast(docs.schema[_MAPS[kind]].dataType)))
    rows = docs.select("shard", F.explode(entries).alias("_e")).select("shard", F.col("_e.key").alias("key"), F.col("_e.value").alias("value"))
    ok = F.col("key").startswith(F.col("shard")) & valid_value(kind, F.col("value"))
    bad = F.raise_error(F.concat(F.lit("invalid row in shard "), F.col("shard"))).cast("string")
    return rows.withColumn("key", F.when(ok, F.col("key")).otherwise(bad)).drop("shard")


def read_shards(spark: SparkSession, path: str, kind: str, snapshot_version: str, shards: list[str] | None = None) -> DataFrame:
    """(key, value) rows of the named shards (all when none are named), every envelope checked."""
    schema = T.StructType([*T.StructType.fromDDL(SHARDS[kind]).fields, T.StructField("key", T.StringType())])
    docs = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if shards is not None:
        # A filter on the folder's own column: folders of other shards are not read.
        docs = docs.where(F.col("key").isin(*shards))
    return open_documents(docs.withColumnRenamed("key", "_folder"), kind, snapshot_version)
