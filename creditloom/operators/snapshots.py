"""Snapshot versions: the active one, publication, pinning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..config import SERVING_SCHEMA
from .tables import upsert


def active_snapshot(snapshots: DataFrame, pinned: str | None = None) -> DataFrame:
    """The pinned snapshot, else the active one published last, then created last."""
    rest = [c for c in snapshots.columns if c not in ("published_at", "created_at")]
    rows = snapshots.where(F.col("status") == "active") if pinned is None else snapshots.where(F.col("snapshot_version") == pinned)
    newest = F.max(F.struct("published_at", "created_at", *rest)).alias("_s")
    return rows.agg(newest).where("_s is not null").select("_s.*").select(*snapshots.columns)


def publish(snapshots: DataFrame, manifest: DataFrame, now: datetime) -> DataFrame:
    """Make the manifest's snapshot the only active one.

    The manifest must carry the serving schema, non-empty texts and a SHA-256 hash.
    """
    texts = ["snapshot_version", "source_url", "license", "attribution", "generated_at", "object_prefix"]
    ok = (F.col("schema_version") == SERVING_SCHEMA) & F.lower("manifest_hash").rlike("^[0-9a-f]{64}$")
    for name in texts:
        ok = ok & (F.length(F.trim(name)) > 0)
    ok = ok & (F.col("recording_count") >= 0) & (F.col("credit_count") >= 0)
    checked = manifest.withColumn(
        "snapshot_version",
        F.when(F.coalesce(ok, F.lit(False)), F.col("snapshot_version")).otherwise(F.raise_error(F.lit("the manifest is not publishable")).cast("string")),
    )
    stamp = F.lit(now)
    row = checked.select(
        "snapshot_version",
        F.col("schema_version").alias("index_schema_version"),
        F.lower("manifest_hash").alias("manifest_hash"),
        F.col("recording_count").alias("record_count"),
        "credit_count",
        F.lit("active").alias("status"),
        "generated_at",
        stamp.alias("published_at"),
        stamp.alias("created_at"),
        "object_prefix",
        F.col("methodology_version") if "methodology_version" in manifest.columns else F.lit(None).cast("string").alias("methodology_version"),
    )
    superseded = snapshots.withColumn("status", F.when(F.col("status") == "active", "superseded").otherwise(F.col("status")))
    return upsert(superseded, row, ["snapshot_version"], keep=("created_at",))


def more_than_one_active(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("status = 'active'").agg(F.count(F.lit(1)).alias("active")).where("active > 1")


def mixed_snapshots(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Reports whose batches do not all carry one version."""
    return batches.groupBy(*keys).agg(
        F.min("snapshot_version").alias("first_version"), F.max("snapshot_version").alias("last_version")
    ).where("first_version <> last_version")


def pin(batches: DataFrame, keys: list[str]) -> DataFrame:
    """One version per report; a report that mixes versions fails."""
    bad = F.raise_error(F.lit("the pinned snapshot changed during collection")).cast("string")
    low, high = F.min("snapshot_version"), F.max("snapshot_version")
    return batches.groupBy(*keys).agg(F.when(low == high, low).otherwise(bad).alias("snapshot_version"))
