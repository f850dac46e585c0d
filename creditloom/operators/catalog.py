"""Catalog reads: assets, editorial sections, slugs, translations, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import match_locale
from ..sources.taxonomy import Taxonomy

# Locales of the catalog.
SOURCE_LOCALE = "pt-BR"
DEFAULT_LOCALE = "en-US"
LOCALES = ("pt-BR", "en-US")
LANGUAGE_LOCALES = {"en": "en-US", "pt": "pt-BR"}


def locale_of(tag: Column) -> Column:
    return match_locale(tag, LOCALES, LANGUAGE_LOCALES)


def resolve_locale(query: Column, saved: Column, languages: Column) -> Column:
    """Requested, else saved, else the first matching browser language, else the default."""
    browser = F.get(F.filter(F.transform(languages, locale_of), lambda t: t.isNotNull()), 0)
    return F.coalesce(locale_of(query), locale_of(saved), browser, F.lit(DEFAULT_LOCALE))


def eligible_assets(images: DataFrame) -> DataFrame:
    """Assets that may be shown: approved or published, no placeholder URL, some URL.

    ``images`` holds asset_id, status, url, output and variants (name, url).
    """
    placeholder = F.exists(F.coalesce("variants", F.array().cast(images.schema["variants"].dataType)), lambda v: F.coalesce(v["url"], F.lit("")).contains("<hash>"))
    detail = F.get(F.filter("variants", lambda v: v["name"] == "detail"), 0)
    url = F.coalesce(F.coalesce(detail, F.get("variants", 0))["url"], F.col("url"), F.col("output"))
    return images.where(F.col("status").isin("approved", "published") & ~placeholder & url.isNotNull()).select("asset_id", url.alias("asset_url"))


def resolve_assets(subjects: DataFrame, instrument_images: DataFrame, fallbacks: DataFrame, family_images: DataFrame, images: DataFrame) -> DataFrame:
    """Exact, else related, else family asset of each (slug, family_slug)."""
    usable = eligible_assets(images)

    def joined(df: DataFrame, mapping: DataFrame, key: str, name: str) -> DataFrame:
        target = mapping.join(usable, "asset_id").select(F.col(mapping.columns[0]).alias(key), F.struct(F.col("asset_id"), F.col("asset_url"), F.lit(name).alias("resolution")).alias(f"_{name}"))
        return df.join(target, key, "left")

    out = joined(subjects, instrument_images, "slug", "exact")
    out = joined(out, fallbacks, "slug", "related")
    out = joined(out, family_images, "family_slug", "family")
    return out.withColumn("_a", F.coalesce("_exact", "_related", "_family")).select(*subjects.columns, "_a.asset_id", "_a.asset_url", "_a.resolution")


def eligible_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(
        (F.col("section_kind") == "curiosity")
        & (F.length(F.trim("text")) > 0)
        & F.col("status").isin("sourced", "reviewed", "published")
        & F.col("claim_support_verified")
    )


def editorial_sections(blocks: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Blocks with at least one citation and none whose source is unverified, citations nested."""
    verified = sources.where("metadata_verified").select(F.col("id").alias("source_id"))
    unverified = citations.join(verified, "source_id", "left_anti").select("block_id").distinct()
    shown = (
        eligible_blocks(blocks)
        .join(citations.select("block_id").distinct(), "block_id", "left_semi")
        .join(unverified, "block_id", "left_anti")
    )
    # The citations of one block are a short list written by an editor.
    listed = citations.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "locator", "citation_note"))).alias("citations"))
    return shown.join(listed, "block_id")


def cited_sources(sections: DataFrame, sources: DataFrame) -> DataFrame:
    used = sections.select("subject_slug", F.explode("citations.source_id").alias("id")).distinct()
    contributors = F.filter(F.from_json("contributors_json", "array<string>"), lambda c: c.isNotNull())
    return used.join(sources, "id").withColumn("contributors", F.coalesce(contributors, F.array().cast("array<string>")))


def resolve_slugs(requests: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Requested slug to canonical slug and entity: an instrument, else a family."""
    aliases = taxonomy.slug_aliases.groupBy("alias_slug").agg(F.max_by("canonical_slug", "kind").alias("_canonical"))
    instruments = taxonomy.instruments.select(F.col("instrument_slug").alias("canonical_slug"), F.col("family_slug").alias("_family"), F.lit(True).alias("_is_instrument"))
    families = taxonomy.families.select(F.col("family_slug").alias("canonical_slug"), F.lit(True).alias("_is_family"))
    named = requests.join(aliases, requests["slug"] == aliases["alias_slug"], "left").withColumn("canonical_slug", F.coalesce("_canonical", "slug"))
    found = named.join(instruments, "canonical_slug", "left").join(families, "canonical_slug", "left")
    kind = F.when(F.col("_is_instrument"), "instrument").when(F.col("_is_family"), "family")
    return found.select(*requests.columns, "canonical_slug", kind.alias("kind"), F.when(F.col("_is_instrument"), F.col("_family")).alias("family_slug"))


def select_translations(requests: DataFrame, publications: DataFrame, translations: DataFrame) -> DataFrame:
    """The text each request gets: its locale when current and approved, else the source
    text, else withheld. A withdrawn source is not revived by a translation.

    ``requests`` holds resource_type, resource_slug, requested_locale and asset_id.
    """
    active = publications.where("status = 'active'").select(F.col("revision").alias("publication_revision"), "content_schema_version")
    keys = ["resource_type", "resource_slug"]
    live = translations.join(active, "publication_revision")
    approved = F.col("status").isin("reviewed", "published") & (F.coalesce("reviewer", F.lit("")) != "") & (F.coalesce("reviewed_at", F.lit("")) != "")
    text = F.struct("locale", "source_revision", "content_revision", "publication_revision", "asset_id", approved.alias("approved"))
    versioned = live.groupBy(*keys).agg(F.max(F.when(F.col("locale") == SOURCE_LOCALE, text)).alias("_source"))
    localized = live.select(*keys, F.col("locale").alias("requested_locale"), text.alias("_wanted"))
    schema = active.agg(F.max("content_schema_version"))
    joined = requests.join(versioned, keys, "left").join(localized, [*keys, "requested_locale"], "left").withColumn("_schema", schema.scalar())
    source_ok = F.coalesce(F.col("_source.approved"), F.lit(False))
    image_ok = F.col("asset_id").isNull() | F.col("_wanted.asset_id").eqNullSafe(F.col("asset_id"))
    wanted_ok = F.coalesce(F.col("_wanted.approved") & (F.col("_wanted.source_revision") == F.col("_source.source_revision")), F.lit(False)) & image_ok
    chosen = F.when(wanted_ok, F.col("_wanted")).when(source_ok, F.col("_source"))
    withheld = F.coalesce(F.col("_schema") == 2, F.lit(False)) & ~source_ok
    return joined.withColumns({"_c": F.when(~withheld, chosen), "withheld": withheld}).select(
        *requests.columns, "withheld", F.col("_c.locale").alias("locale"), F.col("_c.source_revision").alias("source_revision"),
        F.col("_c.content_revision").alias("content_revision"),
    )


def latest_version(versions: DataFrame) -> DataFrame:
    """The catalog version published last; of equals, the greater id."""
    return versions.agg(F.max_by("version", F.struct("published_at", "id")).alias("version"))


def recordings_with_evidence(recordings: DataFrame, active: DataFrame) -> DataFrame:
    """Distinct complete recordings with mapped credits in the active snapshot."""
    rows = recordings.where((F.col("status") == "complete") & (F.col("mapped_credit_count") > 0))
    return rows.join(active.select("snapshot_version"), "snapshot_version", "left_semi").agg(
        F.count_distinct("recording_mbid").alias("recordings_with_evidence")
    )


def translation_coverage(sheets: DataFrame, locales: DataFrame) -> DataFrame:
    """Per locale: approved, current translations of approved sources.

    ``sheets`` holds slug, locale, status, source_revision and review; the row of the
    source locale carries the revision the others must match.
    """
    approved = F.col("status").isin("reviewed", "published") & F.coalesce(
        F.col("review.claim_support_verified") & (F.col("review.reviewer") != "") & (F.col("review.reviewed_at") != ""), F.lit(False)
    )
    good = sheets.where(approved)
    sources = good.where(F.col("locale") == SOURCE_LOCALE).select("slug", F.col("source_revision").alias("_current"))
    current = good.join(sources, "slug").where(F.col("source_revision") == F.col("_current"))
    counts = current.groupBy("locale").agg(F.count(F.lit(1)).alias("translated"))
    total = sources.agg(F.count(F.lit(1))).scalar().alias("total")
    return locales.join(counts, "locale", "left").select("locale", F.coalesce("translated", F.lit(0)).alias("translated"), total)
