"""The batch stages end to end: dump to staging, evidence, serving, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import AGGREGATE_SCHEMA, DEFAULT, SERVING_SCHEMA, STAGING_SCHEMA, Policy
from ..functions import shard_width
from ..operators import evidence as ev
from ..operators import serving as sv
from ..schemas import DUMP_TABLES
from ..sources.dump import read_dump, typed_tables
from ..sources.sinks import read_manifest, shard_documents, write_manifest, write_shards, write_table


def _paths(root: str, names: list[str]) -> dict[str, str]:
    return {name: f"{root}/tables/{name}" for name in names}


def _read(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in _paths(root, names).items()}


def stage(spark: SparkSession, dump: str, root: str, snapshot_version: str, generated_at: str, **texts: str) -> str:
    """Dump text to typed Parquet tables and a manifest."""
    if not snapshot_version.strip():
        raise ValueError("a snapshot version is required")
    raw = read_dump(spark, dump)
    stats = {name: write_table(df, f"{root}/tables/{name}") for name, df in raw.items()}
    return write_manifest(spark, f"{root}/manifest", STAGING_SCHEMA, snapshot_version, stats, generated_at, **texts)


def aggregate(spark: SparkSession, staging: str, root: str, snapshot_version: str, generated_at: str, policy: Policy = DEFAULT) -> str:
    """Staging tables to evidence, aliases and vocabulary.

    Each result is a table of its own, so a lost executor never recomputes the joins
    of an earlier stage.
    """
    manifest = read_manifest(spark, f"{staging}/manifest", STAGING_SCHEMA, snapshot_version)
    missing = [n for n, t in DUMP_TABLES.items() if t.required and n != "artist_credit_name" and n not in manifest["tables"]]
    if missing:
        raise ValueError(f"missing staging tables: {', '.join(missing)}")
    tables = typed_tables(_read(spark, staging, list(manifest["tables"])))
    relations_path = f"{root}/tables/link_relation"
    stats = {"link_relation": write_table(ev.link_relations(tables), relations_path)}
    relations = spark.read.parquet(relations_path)
    direct_path = f"{root}/tables/direct_evidence"
    stats["direct_evidence"] = write_table(ev.direct_evidence(tables, relations, snapshot_version), direct_path)
    direct = spark.read.parquet(direct_path)
    parts = {
        "track_alias": ev.track_aliases(tables, relations, snapshot_version),
        "artist_vocabulary": ev.recurrence_vocabulary(direct, snapshot_version, policy),
    }
    if {"l_artist_release", "medium", "release"} <= tables.keys():
        parts["release_context"] = ev.release_context(tables, relations, snapshot_version)
    stats.update({name: write_table(df, f"{root}/tables/{name}") for name, df in parts.items()})
    texts = {k: manifest[k] for k in ("source_url", "license", "attribution")}
    return write_manifest(
        spark, f"{root}/manifest", AGGREGATE_SCHEMA, snapshot_version, stats, generated_at, parent_hash=manifest["manifest_hash"], **texts
    )


def serve(
    spark: SparkSession, aggregated: str, root: str, snapshot_version: str, generated_at: str, shards: bool = False,
    recording_shards: int = 65_536, track_shards: int = 65_536, artist_shards: int = 4_096, policy: Policy = DEFAULT,
) -> str:
    """Evidence to serving tables and a manifest with all counters.

    The flat tables are what our own jobs read. ``shards`` also writes the nested
    documents for readers that fetch one object at a time.
    """
    manifest = read_manifest(spark, f"{aggregated}/manifest", AGGREGATE_SCHEMA, snapshot_version)
    tables = _read(spark, aggregated, list(manifest["tables"]))
    direct = tables["direct_evidence"].drop("recording", "artist")
    served = sv.serve(direct, tables.get("release_context"), tables["track_alias"], tables["artist_vocabulary"], snapshot_version)
    written = {
        "credit": served.credits,
        "claim_source": sv.claim_sources(served.evidence),
        "alias": served.aliases,
        "vocabulary": served.vocabulary,
    }
    stats = {name: write_table(df, f"{root}/tables/{name}") for name, df in written.items()}
    credits = spark.read.parquet(f"{root}/tables/credit")
    stats["claim"] = write_table(sv.aggregate_claims(credits), f"{root}/tables/claim")
    back = _read(spark, root, ["claim", "alias", "vocabulary", "claim_source"])
    from dataclasses import replace

    counted = replace(served, claims=back["claim"], aliases=back["alias"], vocabulary=back["vocabulary"])
    counters = {k: int(v) for k, v in sv.stage_counters(counted).first().asDict().items()}
    if shards:
        kinds = {
            "recording": (sv.recording_documents(back["claim"], back["claim_source"]), recording_shards),
            "track": (sv.alias_documents(back["alias"]), track_shards),
            "artist": (sv.artist_documents(back["vocabulary"]), artist_shards),
        }
        for kind, (rows, count) in kinds.items():
            write_shards(shard_documents(rows, kind, snapshot_version, shard_width(count), policy), f"{root}/shards/{kind}s")
    texts = {k: manifest[k] for k in ("source_url", "license", "attribution")}
    return write_manifest(
        spark, f"{root}/manifest", SERVING_SCHEMA, snapshot_version, stats, generated_at, parent_hash=manifest["manifest_hash"],
        counters=counters, object_prefix="musicbrainz/instrument-credits/v2", **texts,
    )
