"""Ranked listening histories and the evidence looked up for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, FINISHED_STATUSES, PROJECTION_STATUSES, Policy
from ..functions import canonical_mbid, fold_name, packed_id, strip, unpacked_id

KEYS = ["listener", "period"]

# Length of each listening period in days; the last has no start.
PERIOD_DAYS = {"7day": 7, "1month": 30, "3month": 90, "6month": 180, "12month": 365, "overall": None}


def rank_history(plays: DataFrame, top: int, tie: str = "mbid", policy: Policy = DEFAULT) -> DataFrame:
    """The ``top`` rows of each listener and period by plays, with rank and page.

    The bound on the rank lets Spark trim each listener before the shuffle, so a
    listener with a third of all rows sends at most that many rows per task.
    """
    order = Window.partitionBy(*KEYS).orderBy(F.desc("play_count"), F.asc(tie))
    ranked = plays.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.withColumn("page", F.ceil(F.col("rank") / policy.page_size).cast("bigint"))


def plays_in_periods(log: DataFrame, as_of: Column, item: str = "item") -> DataFrame:
    """Play log (listener, item, ts) to play counts per listener, period and item."""
    return plays_of_days(log.select("listener", item, F.to_date("ts").alias("day"), F.lit(1).alias("plays")), as_of, item)


def plays_of_days(panes: DataFrame, as_of: Column, item: str = "item") -> DataFrame:
    """Plays of days (listener, item, day, plays) to play counts per listener, period and item.

    ``as_of`` is the last day of every period; later days count in none. Each period holds
    the shorter ones, so a day belongs to the shortest that reaches back to it. Days are
    summed per such band first: however long the log, an item is copied into the periods as
    one row a band.
    """
    age = F.datediff(as_of, F.col("day"))
    names = F.array(*map(F.lit, PERIOD_DAYS))
    band = F.lit(len(PERIOD_DAYS))
    for at, days in reversed(list(enumerate(PERIOD_DAYS.values(), 1))):
        band = band if days is None else F.when(age < days, F.lit(at)).otherwise(band)
    bands = panes.where(age >= 0).groupBy("listener", item, band.alias("_band")).agg(F.sum("plays").alias("plays"))
    return (
        bands.select("listener", item, "plays", F.explode(F.slice(names, F.col("_band"), F.lit(len(PERIOD_DAYS)))).alias("period"))
        .groupBy("listener", "period", item).agg(F.sum("plays").alias("play_count"))
    )


def with_keys(tracks: DataFrame) -> DataFrame:
    """Add the artist, title and track keys that make spellings comparable."""
    artist, title = fold_name(F.col("artist")), fold_name(F.col("title"))
    return tracks.withColumns(
        {
            "artist_key": artist,
            "title_key": title,
            "track_key": F.concat_ws("\x00", artist, title, F.coalesce(F.col("mbid"), F.lit(""))),
        }
    )


def canonical_order(tracks: DataFrame) -> DataFrame:
    """Position of each track in the report: artist, title, id."""
    order = Window.partitionBy(*KEYS).orderBy("artist_key", "title_key", F.coalesce("mbid", F.lit("")))
    return tracks.withColumn("position", F.row_number().over(order))


def resolve_identity(tracks: DataFrame, aliases: DataFrame, packed: bool = False) -> DataFrame:
    """Add ``recording_mbid``: the alias of the track id, else the id itself.

    Ids meet packed; with ``packed`` the aliases' ids are so already, and lie as they were dealt.
    """
    track, recording = (F.col(c) if packed else packed_id(F.col(c)) for c in ("track_mbid", "recording_mbid"))
    pairs = aliases.select(track.alias("_track"), recording.alias("_recording"))
    return (
        tracks.withColumns({"_source": packed_id(F.lower("mbid")), "mbid": packed_id(F.col("mbid"))})
        .join(pairs, F.col("_source") == F.col("_track"), "left")
        .withColumns({"mbid": unpacked_id(F.col("mbid")), "recording_mbid": unpacked_id(F.coalesce("_recording", "_source"))})
        .drop("_source", "_track", "_recording")
    )


def known_statuses(statuses: DataFrame) -> DataFrame:
    return statuses.where(F.col("status").isin(*PROJECTION_STATUSES))


def all_recording_statuses(statuses: DataFrame, jobs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Stored statuses, and track jobs out of attempts as failed."""
    spent = (F.col("target_kind") == "track") & (F.col("status") == "failed") & (F.col("attempts") >= policy.max_attempts)
    exhausted = jobs.where(spent).select(F.col("target_mbid").alias("recording_mbid"), F.lit("failed").alias("status"))
    return statuses.select("recording_mbid", "status").unionByName(exhausted)


def one_status(statuses: DataFrame) -> DataFrame:
    """One status per recording: failed outranks the rest, as the later row does upstream."""
    return statuses.groupBy("recording_mbid").agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise(F.max("status")).alias("status")
    )


def recording_status(has_layers: Column, mbid: Column, status: Column) -> Column:
    return (
        F.when(has_layers, "resolved")
        .when(mbid.isNull(), "unresolved_identity")
        .when(status.isin("complete", "complete_empty"), "resolved_without_evidence")
        .when(status == "failed", "terminal_failure")
        .otherwise("pending_enrichment")
    )


def first_artist_names(tracks: DataFrame) -> DataFrame:
    """Per listener and artist id, the name as spelled on the best-ranked track."""
    named = tracks.where("artist_mbid is not null").withColumn("artist_mbid", F.lower(strip(F.col("artist_mbid"))))
    named = named.withColumn("artist_mbid", packed_id(F.col("artist_mbid"))).groupBy(*KEYS, "artist_mbid").agg(F.min_by("artist", "rank").alias("name"))
    return named.withColumn("artist_mbid", unpacked_id(F.col("artist_mbid")))


def profile_totals(tracks: DataFrame) -> DataFrame:
    """Tracks and plays per listener and period. A history without tracks has no row here:
    ``empty_histories`` names those."""
    return tracks.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("tracks_analyzed"), F.coalesce(F.sum("play_count"), F.lit(0)).alias("total_plays")
    )


def empty_histories(listeners: DataFrame, tracks: DataFrame) -> DataFrame:
    return listeners.join(tracks.select("listener").distinct(), "listener", "left_anti")


def unfinished_artists(tracks: DataFrame, artist_statuses: DataFrame) -> DataFrame:
    """Listener artists whose hydration has not ended."""
    valid = tracks.select(*KEYS, canonical_mbid(F.col("artist_mbid")).alias("artist_mbid")).where("artist_mbid is not null").distinct()
    finished = artist_statuses.where(F.col("status").isin(*FINISHED_STATUSES)).select("artist_mbid").distinct()
    return valid.join(finished, "artist_mbid", "left_anti").select(*KEYS, "artist_mbid")


def lookup_counts(
    requests: DataFrame, aliases: DataFrame, statuses: DataFrame, claims: DataFrame,
    artist_requests: DataFrame, artist_statuses: DataFrame, vocabulary: DataFrame,
) -> DataFrame:
    """Per request: how many ids were asked for and how many rows each lookup returns.

    ``requests`` holds (request_id, track_mbid) and ``artist_requests`` holds
    (request_id, artist_mbid). Ids are packed on the way, and an alias counts once. Each projection is first cut to the ids that are asked for, and
    only these are counted per key; so the joins carry one row per id, all requests run as
    one job, and a projection clustered by its id is read where the requests fall.
    """
    def of(rows: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
        """Rows per asked id."""
        return rows.join(ids, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias(name))

    def packed(rows: DataFrame, *names: str) -> DataFrame:
        return rows.withColumns({n: packed_id(F.col(n)) for n in names})

    def unpacked(ids: DataFrame, key: str) -> DataFrame:
        return ids.select(unpacked_id(F.col(key)).alias(key))

    asked = packed(requests, "track_mbid").distinct()
    # A track has few aliases: dealt by the track, they are made distinct where they are joined.
    named = packed(aliases.select("track_mbid", "recording_mbid"), "track_mbid", "recording_mbid").repartition("track_mbid").distinct()
    resolved = (
        asked.join(named.withColumnRenamed("recording_mbid", "_r"), "track_mbid", "left")
        .select("request_id", "track_mbid", F.col("_r").isNotNull().cast("int").alias("_hit"), F.coalesce("_r", "track_mbid").alias("recording_mbid"))
    )
    # One row per request and recording carries the tracks on, so they take no pass of their own.
    pairs = resolved.groupBy("request_id", "recording_mbid").agg(F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_hits"))
    # Projections meet their ids as text, by which they may be clustered.
    ids = unpacked(resolved.select("recording_mbid").distinct(), "recording_mbid")
    per_status, per_claim = (packed(of(rows, ids, "recording_mbid", n), "recording_mbid") for rows, n in ((statuses, "_s"), (claims, "_c")))
    recordings = (
        pairs.join(per_status, "recording_mbid", "left").join(per_claim, "recording_mbid", "left")
        .groupBy("request_id").agg(
            F.sum("_n").alias("tracks"), F.sum("_hits").alias("aliases"),
            F.coalesce(F.sum("_s"), F.lit(0)).alias("recording_statuses"), F.coalesce(F.sum("_c"), F.lit(0)).alias("recording_claims")
        )
    )
    asking = packed(artist_requests, "artist_mbid")
    artist_ids = unpacked(asking.select("artist_mbid").distinct(), "artist_mbid")
    per_artist, per_entry = (packed(of(rows, artist_ids, "artist_mbid", n), "artist_mbid") for rows, n in ((artist_statuses, "_s"), (vocabulary, "_v")))
    artists = (
        asking.distinct()
        .join(per_artist, "artist_mbid", "left").join(per_entry, "artist_mbid", "left")
        .groupBy("request_id").agg(
            F.count(F.lit(1)).alias("artists"),
            F.coalesce(F.sum("_s"), F.lit(0)).alias("artist_statuses"),
            F.coalesce(F.sum("_v"), F.lit(0)).alias("vocabulary_rows"),
        )
    )
    out = recordings.join(artists, "request_id", "full")
    numbers = [c for c in out.columns if c != "request_id"]
    return out.select("request_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers])
