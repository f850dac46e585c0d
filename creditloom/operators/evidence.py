"""Dump relations to evidence rows, track aliases and the recurrence vocabulary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CONTEXT_RELATIONS, DEFAULT, Policy
from ..functions import packed_id, source_url, unpacked_id
from ..sources.dump import union_all


def supported_relation(name: Column) -> Column:
    return name.isin("instrument", *CONTEXT_RELATIONS)


def production_method(relation: Column) -> Column:
    return (
        F.when(relation == "programming", "programmed")
        .when(relation.isin("samples", "sampled"), "sampled")
        .otherwise("performed")
    )


def fallback_name(relation: Column) -> Column:
    """What a context relation without an instrument is called."""
    return F.when(relation.isin("vocal", "vocals"), "voice").otherwise(relation)


def supported_types(link_type: DataFrame) -> DataFrame:
    types = link_type.select(F.col("id").alias("link_type"), F.lower("name").alias("relation_type"))
    return types.where(supported_relation(F.col("relation_type")))


def typed_links(link: DataFrame, link_type: DataFrame) -> DataFrame:
    """Links with their lower-cased relation; the filter sits on the small side of the join."""
    return link.join(supported_types(link_type), "link_type").select(F.col("id").alias("link"), "relation_type")


def attribute_instruments(attribute_type: DataFrame, instrument: DataFrame) -> DataFrame:
    """Attribute types with the instrument of the same gid, where there is one."""
    known = instrument.select("gid", F.col("gid").alias("instrument_mbid"), F.col("name").alias("instrument_name"))
    return attribute_type.join(known, "gid", "left").select(
        F.col("id").alias("attribute_type"), F.col("name").alias("attribute_name"), "instrument_mbid", "instrument_name"
    )


def link_attributes(link_attribute: DataFrame, types: DataFrame) -> DataFrame:
    """Attributes of each link; unknown attribute types drop out."""
    return link_attribute.join(types, "attribute_type")


def credited_names(credit: DataFrame) -> DataFrame:
    """Greatest non-empty credited-as text per link and attribute type."""
    text = F.nullif(F.col("credited_as"), F.lit(""))
    return (
        credit.where(text.isNotNull()).groupBy("link", "attribute_type").agg(F.max(text).alias("original_credit"))
    )


def link_relations(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per supported link: relation, attribute names, instruments, credited-as text.

    The two sets are bounded by the number of attribute types, and ``collect_set``
    drops repeats before the shuffle.
    """
    links = typed_links(tables["link"], tables["link_type"])
    types = attribute_instruments(tables["link_attribute_type"], tables["instrument"])
    # Only attributes of supported links go on.
    wanted = tables["link_attribute"].join(links.select("link"), "link", "left_semi")
    attributes = link_attributes(wanted, types)
    if "link_attribute_credit" in tables:
        attributes = attributes.join(credited_names(tables["link_attribute_credit"]), ["link", "attribute_type"], "left")
    else:
        attributes = attributes.withColumn("original_credit", F.lit(None).cast("string"))
    instrument = F.when(F.col("instrument_mbid").isNotNull(), F.struct("instrument_mbid", "instrument_name"))
    rolled = attributes.groupBy("link").agg(
        F.array_sort(F.collect_set("attribute_name")).alias("attributes"),
        F.array_sort(F.collect_set(instrument)).alias("instruments"),
        F.max("original_credit").alias("original_credit"),
    )
    empty = F.array().cast("array<string>")
    return links.join(rolled, "link", "left").select(
        "link",
        "relation_type",
        F.coalesce("attributes", empty).alias("attributes"),
        F.coalesce("instruments", F.array().cast(rolled.schema["instruments"].dataType)).alias("instruments"),
        "original_credit",
    )


def link_credits(relations: DataFrame) -> DataFrame:
    """One row per link and instrument, with all that evidence takes from its link.

    A context relation without an instrument keeps a null-instrument row; an instrument
    relation without one yields nothing."""
    rows = (
        relations.withColumn("instrument", F.explode_outer("instruments"))
        .where((F.col("relation_type") != "instrument") | F.col("instrument").isNotNull())
        .select(
            "link",
            "relation_type",
            "attributes",
            "original_credit",
            F.col("instrument.instrument_mbid").alias("instrument_mbid"),
            F.coalesce("instrument.instrument_name", fallback_name(F.col("relation_type"))).alias("instrument_name"),
            production_method(F.col("relation_type")).alias("production_method"),
        )
    )
    return rows.withColumns(
        {
            "attributes": F.array_union("attributes", F.array("instrument_name")),
            "original_credit": F.coalesce("original_credit", "instrument_name"),
        }
    )


def _artists(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["artist"].select(
        F.col("id").alias("artist"), F.col("gid").alias("artist_mbid"), F.col("name").alias("performer")
    )


def _recordings(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["recording"].select(
        F.col("id").alias("recording"), F.col("gid").alias("recording_mbid"), F.col("title").alias("recording_title")
    )


def supported_credits(tables: dict[str, DataFrame], relation_table: str, relations: DataFrame) -> DataFrame:
    """Relation rows whose link is supported."""
    return tables[relation_table].join(relations.select("link"), "link", "left_semi")


def direct_rows(tables: dict[str, DataFrame], credits: DataFrame, recordings: DataFrame, artists: DataFrame) -> DataFrame:
    return (
        tables["l_artist_recording"].select("link", "artist", "recording")
        .join(credits, "link")
        .join(recordings, "recording")
        .join(artists, "artist", "left")
    )


def direct_evidence(tables: dict[str, DataFrame], relations: DataFrame, snapshot_version: str) -> DataFrame:
    """One row per recording credit and instrument."""
    rows = direct_rows(tables, link_credits(relations), _recordings(tables), _artists(tables))
    return rows.select(
        "recording", "artist", "recording_mbid", "recording_title", "artist_mbid", "performer",
        "instrument_mbid", "instrument_name", "attributes", "original_credit",
        F.lit("recording").alias("scope"), "relation_type", "production_method",
        source_url("recording", F.col("recording_mbid")).alias("source_url"), F.lit(snapshot_version).alias("snapshot_version"),
    )


def release_recordings(tables: dict[str, DataFrame], releases: DataFrame) -> DataFrame:
    """Distinct (release, recording) pairs of the given releases."""
    media = tables["medium"].select(F.col("id").alias("medium"), "release").join(releases, "release", "left_semi")
    return tables["track"].select("recording", "medium").join(media, "medium").select("release", "recording").distinct()


def credited_releases(tables: dict[str, DataFrame], relations: DataFrame) -> DataFrame:
    """Releases named by a supported relation."""
    return supported_credits(tables, "l_artist_release", relations).select("release").distinct()


def release_rows(tables: dict[str, DataFrame], credits: DataFrame, recordings: DataFrame, artists: DataFrame) -> DataFrame:
    releases = tables["release"].select(
        F.col("id").alias("release"), F.col("gid").alias("release_mbid"), F.col("title").alias("release_title")
    )
    # Recordings join their releases first, as numbers: what is fanned out has its texts and moves no more.
    bridge = release_recordings(tables, credited_releases(tables, credits)).join(recordings, "recording")
    return (
        tables["l_artist_release"].select("link", "artist", "release")
        .join(credits, "link")
        .join(artists, "artist", "left")
        # Both joins by release share the rows' last shuffle; the fan-out to recordings comes last.
        .join(releases, "release")
        .join(bridge, "release")
    )


def release_context(tables: dict[str, DataFrame], relations: DataFrame, snapshot_version: str) -> DataFrame:
    """Release credits spread over the release's recordings: context, never direct evidence."""
    rows = release_rows(tables, link_credits(relations), _recordings(tables), _artists(tables))
    return rows.select(
        "recording_mbid", "recording_title", "release_mbid", "release_title", "artist_mbid", "performer",
        "instrument_mbid", "instrument_name", "attributes", "original_credit",
        F.lit("release").alias("scope"), "relation_type", "production_method",
        source_url("release", F.col("release_mbid")).alias("source_url"), F.lit(snapshot_version).alias("snapshot_version"),
    )


def relevant_recordings(tables: dict[str, DataFrame], relations: DataFrame) -> DataFrame:
    """Recordings credited directly or standing on a credited release."""
    direct = supported_credits(tables, "l_artist_recording", relations).select("recording")
    if not {"l_artist_release", "medium"} <= tables.keys():
        return direct.distinct()
    bridge = release_recordings(tables, credited_releases(tables, relations))
    return direct.union(bridge.select("recording")).distinct()


def relevant_artists(tables: dict[str, DataFrame], relations: DataFrame) -> DataFrame:
    names = [name for name in ("l_artist_recording", "l_artist_release") if name in tables]
    return union_all([supported_credits(tables, name, relations).select("artist") for name in names]).distinct()


def track_aliases(
    tables: dict[str, DataFrame], relations: DataFrame, snapshot_version: str, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Track id to recording id for every relevant recording.

    The whole relevant set is known before tracks are read, so the result does not
    depend on the order of the track table. ``keep`` may cut the recordings before tracks join them.
    """
    recordings = keep(_recordings(tables).join(relevant_recordings(tables, relations), "recording", "left_semi"))
    return (
        tables["track"].select(packed_id(F.col("gid")).alias("_track"), "recording")
        .join(recordings, "recording")
        .withColumn("track_mbid", unpacked_id(F.col("_track")))
        .select(
            "track_mbid",
            "recording_mbid",
            source_url("track", F.col("track_mbid")).alias("source_url"),
            F.lit(snapshot_version).alias("snapshot_version"),
        )
    )


def recurrence_vocabulary(direct: DataFrame, snapshot_version: str, policy: Policy = DEFAULT) -> DataFrame:
    """Per artist and instrument: distinct recordings, their share of the artist's
    documented recordings, and whether the count qualifies.

    Both counts come from one distinct set of (artist, recording, instrument) ids. Texts are
    joined to the small result: their spellings are made distinct by hashing first, so the
    greatest spelling is taken of a few rows per artist and instrument.
    """
    seen = direct.select("artist", "recording", "instrument_mbid").distinct()
    # A null-instrument row documents the recording without adding to any instrument.
    documented = seen.select("artist", "recording").distinct().groupBy("artist").agg(F.count(F.lit(1)).alias("documented_recordings"))
    counts = seen.where("instrument_mbid is not null").groupBy("artist", "instrument_mbid").agg(F.count(F.lit(1)).alias("distinct_recordings"))
    who = direct.select("artist", "artist_mbid", F.col("performer").alias("artist_name")).distinct()
    who = who.groupBy("artist").agg(F.max("artist_mbid").alias("artist_mbid"), F.max("artist_name").alias("artist_name"))
    what = direct.where("instrument_mbid is not null").select("instrument_mbid", "instrument_name").distinct()
    what = what.groupBy("instrument_mbid").agg(F.max("instrument_name").alias("instrument_name"))
    counted = counts.join(who, "artist").join(what, "instrument_mbid")
    return counted.join(documented, "artist").select(
        "artist_mbid",
        "artist_name",
        "instrument_mbid",
        "instrument_name",
        "distinct_recordings",
        "documented_recordings",
        (F.col("distinct_recordings") / F.col("documented_recordings")).alias("prevalence"),
        (F.col("distinct_recordings") >= policy.min_recordings).alias("qualifying"),
        F.lit(snapshot_version).alias("snapshot_version"),
    )


@dataclass(frozen=True)
class Aggregate:
    direct: DataFrame
    release: DataFrame | None
    aliases: DataFrame
    vocabulary: DataFrame


def aggregate(tables: dict[str, DataFrame], snapshot_version: str, policy: Policy = DEFAULT) -> Aggregate:
    """Typed dump tables to the four evidence tables."""
    relations = link_relations(tables)
    direct = direct_evidence(tables, relations, snapshot_version)
    has_release = {"l_artist_release", "medium", "release"} <= tables.keys()
    return Aggregate(
        direct=direct.drop("recording", "artist"),
        release=release_context(tables, relations, snapshot_version) if has_release else None,
        aliases=track_aliases(tables, relations, snapshot_version),
        vocabulary=recurrence_vocabulary(direct, snapshot_version, policy),
    )
