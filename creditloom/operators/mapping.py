"""Claims and vocabularies onto the controlled taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DIRECT_SCOPES
from ..functions import bounded_text, valid_slug, with_normalized_alias
from ..sources.taxonomy import Taxonomy


def alias_dimension(taxonomy: Taxonomy) -> DataFrame:
    """Alias form to subject, tagged by level; an instrument beats a family of the same name."""
    families = taxonomy.instruments.select("instrument_slug", "family_slug")
    by_instrument = taxonomy.instrument_aliases.join(families, "instrument_slug").select(
        "normalized_alias", F.lit("instrument").alias("claim_level"), "instrument_slug", "family_slug"
    )
    by_family = taxonomy.family_aliases.select(
        "normalized_alias", F.lit("family").alias("claim_level"), F.lit(None).cast("string").alias("instrument_slug"), "family_slug"
    )
    first = F.struct((F.col("claim_level") != "instrument").alias("_rank"), "claim_level", "instrument_slug", "family_slug")
    return (
        by_instrument.unionByName(by_family)
        .groupBy("normalized_alias").agg(F.min(first).alias("_m"))
        .select("normalized_alias", "_m.claim_level", "_m.instrument_slug", "_m.family_slug")
    )


def resolve(rows: DataFrame, taxonomy: Taxonomy, instruments_only: bool = False) -> DataFrame:
    """Add claim_level, subject_slug, instrument_slug and family_slug; null where nothing maps.

    An external id decides first, then the name. ``instruments_only`` refuses family names.
    """
    by_id = taxonomy.external_ids.join(taxonomy.instruments.select("instrument_slug", "family_slug"), "instrument_slug").select(
        F.col("external_id").alias("instrument_mbid"), F.col("instrument_slug").alias("_id_slug"), F.col("family_slug").alias("_id_family")
    )
    names = alias_dimension(taxonomy)
    if instruments_only:
        names = names.where("claim_level = 'instrument'")
    names = names.select(
        F.col("normalized_alias").alias("_alias"), F.col("claim_level").alias("_level"),
        F.col("instrument_slug").alias("_name_slug"), F.col("family_slug").alias("_name_family"),
    )
    named = with_normalized_alias(rows, "instrument_name", "_alias")
    level = F.when(F.col("_id_slug").isNotNull(), "instrument").otherwise(F.col("_level"))
    instrument = F.coalesce("_id_slug", "_name_slug")
    family = F.when(F.col("_id_slug").isNotNull(), F.col("_id_family")).otherwise(F.col("_name_family"))
    return named.join(by_id, "instrument_mbid", "left").join(names, "_alias", "left").select(
        *rows.columns,
        level.alias("claim_level"),
        F.when(level == "instrument", instrument).otherwise(family).alias("subject_slug"),
        F.when(level == "instrument", instrument).alias("instrument_slug"),
        family.alias("family_slug"),
    )


def map_claims(claims: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Mapped claims per recording, subject and scope. Performer counts add up: they
    are no longer distinct once several names map to one subject."""
    mapped = resolve(claims, taxonomy).where("subject_slug is not null")
    return mapped.groupBy("recording_mbid", "claim_level", "subject_slug", "instrument_slug", "family_slug", "scope").agg(
        F.sum("credit_count").alias("credit_count"),
        F.sum("performer_count").alias("performer_count"),
        F.min("source_url").alias("source_url"),
    )


def recording_totals(claims: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Per recording: credits, mapped and discarded credits, resulting status."""
    mapped = F.when(F.col("subject_slug").isNotNull(), F.col("credit_count")).otherwise(F.lit(0))
    totals = resolve(claims, taxonomy).groupBy("recording_mbid").agg(
        F.sum("credit_count").alias("credit_count"), F.sum(mapped).alias("mapped_credit_count")
    )
    return totals.select(
        "*",
        (F.col("credit_count") - F.col("mapped_credit_count")).alias("discarded_credit_count"),
        F.when(F.col("mapped_credit_count") > 0, "complete").otherwise("complete_empty").alias("status"),
    )


def map_vocabulary(vocabulary: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Vocabulary entries per artist and instrument."""
    mapped = resolve(vocabulary, taxonomy, instruments_only=True).where("subject_slug is not null")
    return mapped.groupBy("artist_mbid", "instrument_slug", "family_slug").agg(
        F.sum("distinct_recordings").alias("distinct_recordings"),
        F.sum("documented_recordings").alias("documented_recordings"),
        F.max("prevalence").alias("prevalence"),
        F.bool_or("qualifying").alias("qualifying"),
    )


def artist_totals(vocabulary: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    totals = resolve(vocabulary, taxonomy, instruments_only=True).groupBy("artist_mbid").agg(
        F.count(F.lit(1)).alias("entry_count"), F.count("subject_slug").alias("mapped_entry_count")
    )
    return totals.select(
        "*",
        (F.col("entry_count") - F.col("mapped_entry_count")).alias("discarded_entry_count"),
        F.when(F.col("mapped_entry_count") > 0, "complete").otherwise("complete_empty").alias("status"),
    )


def direct_only(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("scope").isin(*DIRECT_SCOPES))


def enrich_claims(claims: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Names and sound nature; the instrument's nature comes before the family's."""
    instruments = taxonomy.instruments.select("instrument_slug", "instrument_name", "instrument_nature")
    return (
        claims.join(instruments, "instrument_slug", "left")
        .join(taxonomy.families, "family_slug")
        .withColumn("sound_nature", F.coalesce("instrument_nature", "family_nature"))
        .drop("instrument_nature", "family_nature")
    )


def enrich_vocabulary(vocabulary: DataFrame, taxonomy: Taxonomy, evidence_quality: float = 1.0) -> DataFrame:
    """Mapped vocabulary with names, the quality of its evidence and its scope."""
    families = taxonomy.families.select("family_slug", "family_name")
    rows = vocabulary.join(taxonomy.instruments.select("instrument_slug", "instrument_name"), "instrument_slug").join(families, "family_slug")
    return rows.withColumns({"evidence_quality": F.lit(evidence_quality), "source_scope": F.lit("recording")})


def consistent_claim(level: Column, subject: Column, instrument: Column, family: Column) -> Column:
    """Instrument claims name their instrument; family claims name only their family."""
    as_instrument = (level == "instrument") & instrument.isNotNull() & instrument.eqNullSafe(subject)
    as_family = (level == "family") & instrument.isNull() & subject.eqNullSafe(family)
    valid = valid_slug(subject).isNotNull() & valid_slug(family).isNotNull()
    return F.coalesce((as_instrument | as_family) & valid, F.lit(False))


def assemble_layers(claims: DataFrame) -> DataFrame:
    """One layer per recording and subject from enriched direct claims."""
    ok = consistent_claim(F.col("claim_level"), F.col("subject_slug"), F.col("instrument_slug"), F.col("family_slug"))
    rows = claims.where(ok).select(
        "recording_mbid",
        F.col("subject_slug").alias("slug"),
        F.coalesce(bounded_text(F.col("instrument_name"), 256), bounded_text(F.col("family_name"), 256), F.col("subject_slug")).alias("name"),
        "family_slug",
        F.coalesce(bounded_text(F.col("family_name"), 256), F.col("family_slug")).alias("family_name"),
        F.col("sound_nature").alias("nature"),
        "claim_level",
    )
    best = F.min(F.struct(F.col("claim_level") != "instrument", "name", "family_slug", "family_name", "nature", "claim_level")).alias("_l")
    return rows.groupBy("recording_mbid", "slug").agg(best).select(
        "recording_mbid", "slug", "_l.name", "_l.family_slug", "_l.family_name", "_l.nature",
        F.lit("documented").alias("confidence"), F.lit(1.0).alias("prominence"), "_l.claim_level",
    )
