"""The job table: eligibility, bulk materialization, retries, budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Policy
from ..functions import day_key, retry_delay_seconds, shard_key
from ..sources.taxonomy import Taxonomy
from . import mapping
from .tables import insert_new, replace_children, upsert


def units(kind: Column) -> Column:
    """A track job reserves a second unit for its later recording job."""
    return F.when(kind == "track", 2).otherwise(1)


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def eligible_jobs(jobs: DataFrame, active: DataFrame, now: Column, policy: Policy = DEFAULT) -> DataFrame:
    """Jobs of the active snapshot that are due, or whose lease ran out."""
    due = (
        F.col("status").isin("pending", "failed")
        & (F.col("attempts") < policy.max_attempts)
        & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    )
    stale = (
        (F.col("status") == "processing")
        & (F.col("attempts") <= policy.max_attempts)
        & (F.col("updated_at") <= now - minutes(policy.lease_minutes))
    )
    return jobs.where(due | stale).join(active.select("snapshot_version"), "snapshot_version", "left_semi")


def oldest_jobs(eligible: DataFrame, n: int) -> DataFrame:
    """The n oldest jobs of each snapshot, by creation then id.

    The bound on the rank trims every task's rows before the shuffle.
    """
    order = Window.partitionBy("snapshot_version").orderBy("created_at", "id")
    return eligible.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def claim_jobs(jobs: DataFrame, now: Column, policy: Policy = DEFAULT) -> DataFrame:
    """Take a lease. A retaken final attempt is not counted twice."""
    again = (F.col("status") == "processing") & (F.col("attempts") == policy.max_attempts)
    return jobs.withColumns(
        {
            "attempts": F.when(again, F.col("attempts")).otherwise(F.col("attempts") + 1),
            "status": F.lit("processing"),
            "last_error": F.lit(None).cast("string"),
            "next_attempt_at": F.lit(None).cast("timestamp"),
            "updated_at": now,
        }
    )


def fail_jobs(jobs: DataFrame, now: Column, error: Column, terminal: Column, policy: Policy = DEFAULT) -> DataFrame:
    """Outcome of a failure: terminal, or due again after the delay of its attempt."""
    ended = terminal | (F.col("attempts") >= policy.max_attempts)
    delay = F.make_dt_interval(secs=retry_delay_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return jobs.withColumn("_ended", ended).withColumns(
        {
            "next_attempt_at": F.when(~F.col("_ended"), now + delay),
            "attempts": F.when(F.col("_ended"), F.lit(policy.max_attempts)).otherwise(F.col("attempts")),
            "status": F.lit("failed"),
            "last_error": error,
            "updated_at": now,
        }
    ).withColumnRenamed("_ended", "terminal")


def defer_jobs(jobs: DataFrame, now: Column, reason: str, policy: Policy = DEFAULT) -> DataFrame:
    """Put jobs back; the attempt is not charged."""
    return jobs.withColumns(
        {
            "status": F.lit("pending"),
            "attempts": F.greatest(F.col("attempts") - 1, F.lit(0)),
            "last_error": F.lit(reason),
            "next_attempt_at": now + minutes(policy.defer_minutes),
            "updated_at": now,
        }
    )


@dataclass(frozen=True)
class Projections:
    """Tables the hydrator maintains."""

    aliases: DataFrame
    recordings: DataFrame
    recording_claims: DataFrame
    artists: DataFrame
    artist_instruments: DataFrame
    jobs: DataFrame


@dataclass(frozen=True)
class Servings:
    """Flat serving tables of one snapshot."""

    aliases: DataFrame
    claims: DataFrame
    vocabulary: DataFrame


def materialize(jobs: DataFrame, served: Servings, taxonomy: Taxonomy, now: Column) -> Projections:
    """New projection rows for all claimed jobs, one join per kind of target.

    A target the snapshot does not serve becomes ``complete_empty``. A track job
    leaves its alias and a job for the recording.
    """
    def of(kind: str, name: str) -> DataFrame:
        return jobs.where(F.col("target_kind") == kind).select("snapshot_version", F.col("target_mbid").alias(name)).distinct()

    wanted = of("recording", "recording_mbid")
    claims = served.claims.join(wanted.select("recording_mbid").distinct(), "recording_mbid", "left_semi")
    mapped = mapping.map_claims(claims, taxonomy)
    totals = mapping.recording_totals(claims, taxonomy)
    numbers = ["credit_count", "mapped_credit_count", "discarded_credit_count"]
    recordings = wanted.join(totals, "recording_mbid", "left").select(
        "snapshot_version", "recording_mbid", F.coalesce("status", F.lit("complete_empty")).alias("status"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers], F.lit(None).cast("string").alias("last_error"), now.alias("updated_at"),
    )

    tracks = of("track", "track_mbid").join(served.aliases.select("track_mbid", "recording_mbid"), "track_mbid", "left")
    follow_up = F.coalesce("recording_mbid", "track_mbid")
    new_jobs = tracks.select("snapshot_version", F.lit("recording").alias("target_kind"), follow_up.alias("target_mbid")).distinct()

    wanted_artists = of("artist", "artist_mbid")
    entries = served.vocabulary.join(wanted_artists.select("artist_mbid").distinct(), "artist_mbid", "left_semi")
    artist_numbers = ["entry_count", "mapped_entry_count", "discarded_entry_count"]
    artists = wanted_artists.join(mapping.artist_totals(entries, taxonomy), "artist_mbid", "left").select(
        "snapshot_version", "artist_mbid", F.coalesce("status", F.lit("complete_empty")).alias("status"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in artist_numbers], F.lit(None).cast("string").alias("last_error"), now.alias("updated_at"),
    )
    return Projections(
        aliases=tracks.where("recording_mbid is not null").select("snapshot_version", "track_mbid", "recording_mbid"),
        recordings=recordings,
        recording_claims=wanted.join(mapped, "recording_mbid"),
        artists=artists,
        artist_instruments=wanted_artists.join(mapping.map_vocabulary(entries, taxonomy), "artist_mbid"),
        jobs=new_jobs,
    )


def follow_up_jobs(jobs: DataFrame, new_jobs: DataFrame, now: Column) -> DataFrame:
    """Append recording jobs that are not queued yet; ids come from a digest of the key,
    so they need no counter shared by all tasks."""
    key = ["snapshot_version", "target_kind", "target_mbid"]
    shaped = new_jobs.select(
        F.xxhash64(*key).alias("id"), *key, shard_key(F.col("target_mbid"), 4).alias("shard_key"), F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("attempts"), now.alias("created_at"), now.alias("updated_at"),
    )
    return insert_new(jobs, shaped, key)


def commit(old: Projections, claimed: DataFrame, new: Projections, now: Column) -> Projections:
    """Projection tables after a batch. Running it twice gives the same tables."""
    key = ["snapshot_version", "target_kind", "target_mbid"]
    done = claimed.withColumns({"status": F.lit("complete"), "last_error": F.lit(None).cast("string"), "next_attempt_at": F.lit(None).cast("timestamp"), "updated_at": now})
    jobs = upsert(old.jobs, done.select(*[c for c in old.jobs.columns if c in done.columns]), key)
    return Projections(
        aliases=upsert(old.aliases, new.aliases, ["snapshot_version", "track_mbid"]),
        recordings=upsert(old.recordings, new.recordings, ["snapshot_version", "recording_mbid"]),
        recording_claims=replace_children(old.recording_claims, new.recordings, new.recording_claims, ["snapshot_version", "recording_mbid"]),
        artists=upsert(old.artists, new.artists, ["snapshot_version", "artist_mbid"]),
        artist_instruments=replace_children(old.artist_instruments, new.artists, new.artist_instruments, ["snapshot_version", "artist_mbid"]),
        jobs=follow_up_jobs(jobs, new.jobs, now),
    )


def request_units(requests: DataFrame, jobs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Fresh units of each request, with the backlog and the usage of its day.

    ``requests`` holds (request_id, ts, kind, target_mbid). A target counts for the
    first request that brings it; queued targets are free.
    """
    key = ["kind", "target_mbid"]
    queued = jobs.select(F.col("target_kind").alias("kind"), "target_mbid").distinct()
    firsts = requests.groupBy(*key).agg(F.min(F.struct("ts", "request_id")).alias("_f")).join(queued, key, "left_anti")
    per_request = firsts.groupBy(F.col("_f.request_id").alias("request_id")).agg(F.sum(units(F.col("kind"))).alias("fresh_units"))
    asked = requests.groupBy("request_id").agg(F.min("ts").alias("ts"))
    waiting = F.when((F.col("status") != "complete") & ((F.col("status") == "processing") | (F.col("attempts") < policy.max_attempts)), units(F.col("target_kind")))
    backlog = jobs.agg(F.coalesce(F.sum(waiting), F.lit(0)).alias("_backlog"))
    used = jobs.groupBy(day_key(F.col("created_at")).alias("day")).agg(F.sum(units(F.col("target_kind"))).alias("_used"))
    rows = asked.join(per_request, "request_id", "left").withColumn("day", day_key(F.col("ts"))).join(used, "day", "left")
    return rows.select(
        "request_id", "ts", "day", F.coalesce("fresh_units", F.lit(0)).alias("fresh_units"),
        backlog.scalar().alias("backlog_units"), F.coalesce("_used", F.lit(0)).alias("used_units"),
    )


def budget_ledger(usage: DataFrame, key: Column, limit: int, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Running usage per period and whether each reservation still fits its limit.

    ``usage`` holds ts, an order column and units. Refused reservations stay charged,
    so the running sum is one prefix sum. It is taken in three levels: hours of a period,
    seconds of an hour, rows of a second. The first two are summed before they are shuffled,
    so a task holds no more than one second's rows of a busy hour.
    """
    keyed = usage.withColumns({"period": key, "_hour": F.date_trunc("hour", "ts"), "_second": F.date_trunc("second", "ts")})
    seconds = keyed.groupBy("period", "_hour", "_second").agg(F.sum("units").alias("_u"))
    hours = seconds.groupBy("period", "_hour").agg(F.sum("_u").alias("_h"))

    def earlier(value: str, within: list[str], by: str) -> Column:
        before = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    hours = hours.select("period", "_hour", earlier("_h", ["period"], "_hour").alias("_hours"))
    seconds = seconds.select("period", "_hour", "_second", earlier("_u", ["period", "_hour"], "_second").alias("_seconds"))
    offsets = seconds.join(hours, ["period", "_hour"]).select("period", "_second", (F.col("_hours") + F.col("_seconds")).alias("_before"))
    within = Window.partitionBy("period", "_second").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = keyed.withColumn("_within", F.sum("units").over(within)).join(offsets, ["period", "_second"])
    total = F.col("_before") + F.col("_within")
    return running.withColumns({"charged": total, "admitted": total <= F.lit(limit)}).drop("_hour", "_second", "_before", "_within")


def budget_summary(usage: DataFrame, key: Column, limit: int) -> DataFrame:
    """Units per period and whether they stay within the limit."""
    return usage.groupBy(key.alias("period")).agg(F.sum("units").alias("units")).withColumn("within_limit", F.col("units") <= limit)
