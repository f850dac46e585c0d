"""Editorial data quality: rules, revisions, staleness, withdrawal, split and expand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .catalog import SOURCE_LOCALE
from .tables import dangling, duplicate_keys

# Accepted states and source kinds.
BLOCK_STATUSES = ("draft", "sourced", "reviewed", "published", "deprecated")
READING_STATUSES = ("draft", "reviewed", "published", "deprecated")
TRANSLATION_STATUSES = ("draft", "reviewed", "published", "deprecated", "stale")
SOURCE_TYPES = (
    "classification", "museum", "archive", "foundation", "institution", "manufacturer", "society", "university",
    "library", "book", "article", "primary", "government", "collaborative", "official", "other",
)

_REVIEW = "struct<claim_support_verified: boolean, reviewer: string, reviewed_at: string>"
SHEET = (
    "kind string, slug string, family_slug string, name string, description string, sound_production string, "
    "common_roles array<string>, "
    "sections array<struct<id: string, kind: string, text: string, content_type: string, status: string, "
    f"citations: array<struct<source_id: string, locator: string, note: string>>, review: {_REVIEW}>>, "
    "sources array<struct<id: string, title: string, contributors: array<string>, publisher: string, url: string, "
    "accessed_at: string, source_type: string, metadata_verified: boolean, verified_at: string>>, "
    "further_reading array<struct<title: string, url: string, publisher: string, status: string, reviewer: string, reviewed_at: string>>, "
    "image struct<asset_id: string, alt: string, caption: string>, "
    "text_citations struct<description: array<string>, sound_production: array<string>>, "
    f"review {_REVIEW}, locale string, status string, source_revision string"
)


def _sheet() -> T.StructType:
    return T.StructType.fromDDL(SHEET)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _http(c: Column) -> Column:
    return F.coalesce(c.startswith("https://") | c.startswith("http://"), F.lit(False))


def _false(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _unnamed_review(review: Column) -> Column:
    return _blank(review["reviewer"]) | _blank(review["reviewed_at"])


def sheet_violations(sheets: DataFrame, source_types: tuple[str, ...] = SOURCE_TYPES) -> DataFrame:
    """(slug, locale, violation) for every rule a sheet breaks, and for keys used twice."""
    source_ids = F.transform("sources", lambda s: s["id"])
    rules = {
        "slug": _false(F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")),
        "kind": _false(F.col("kind").isin("instrument", "family")),
        "family_slug": (F.col("kind") == "instrument") & F.col("family_slug").isNull(),
        "name": _blank(F.col("name")),
        "description": _blank(F.col("description")),
        "sound_production": _blank(F.col("sound_production")),
        "review_identity": F.coalesce(F.col("review.claim_support_verified"), F.lit(False)) & _unnamed_review(F.col("review")),
        "source_fields": F.exists("sources", lambda s: _blank(s["id"]) | _blank(s["title"]) | _blank(s["accessed_at"])),
        "source_type": F.exists("sources", lambda s: _false(s["source_type"].isin(*source_types))),
        "source_url": F.exists("sources", lambda s: s["url"].isNotNull() & ~_http(s["url"])),
        "source_verified_at": F.exists("sources", lambda s: F.coalesce(s["metadata_verified"], F.lit(False)) & _blank(s["verified_at"])),
        "text_citation_unknown": F.size(F.array_except(F.concat("text_citations.description", "text_citations.sound_production"), source_ids)) > 0,
        "text_citation_repeated": (F.size(F.array_distinct("text_citations.description")) < F.size("text_citations.description"))
        | (F.size(F.array_distinct("text_citations.sound_production")) < F.size("text_citations.sound_production")),
        "block_fields": F.exists("sections", lambda b: _blank(b["id"]) | _blank(b["text"])),
        "block_kind": F.exists("sections", lambda b: _false(b["kind"] == "curiosity")),
        "block_status": F.exists("sections", lambda b: _false(b["status"].isin(*BLOCK_STATUSES))),
        "citation_unknown": F.exists("sections", lambda b: F.size(F.array_except(F.transform(b["citations"], lambda c: c["source_id"]), source_ids)) > 0),
        "citation_repeated": F.exists("sections", lambda b: F.size(F.array_distinct(F.transform(b["citations"], lambda c: c["source_id"]))) < F.size(b["citations"])),
        "citation_required": F.exists("sections", lambda b: (b["status"] != "draft") & (F.size(b["citations"]) == 0)),
        "support_required": F.exists("sections", lambda b: b["status"].isin("reviewed", "published") & _false(b["review"]["claim_support_verified"])),
        "source_unverified": F.exists(
            "sections",
            lambda b: b["status"].isin("sourced", "reviewed", "published")
            & F.coalesce(b["review"]["claim_support_verified"], F.lit(False))
            & F.exists(b["citations"], lambda c: F.exists("sources", lambda s: (s["id"] == c["source_id"]) & _false(s["metadata_verified"]))),
        ),
        "block_review_identity": F.exists("sections", lambda b: b["status"].isin("reviewed", "published") & _unnamed_review(b["review"])),
        "reading_fields": F.exists("further_reading", lambda r: _blank(r["title"]) | ~_http(r["url"])),
        "reading_status": F.exists("further_reading", lambda r: _false(F.coalesce(r["status"], F.lit("draft")).isin(*READING_STATUSES))),
        "reading_review_identity": F.exists("further_reading", lambda r: r["status"].isin("reviewed", "published") & _unnamed_review(r)),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    own = sheets.select("slug", "locale", F.explode(broken).alias("violation"))
    repeated = duplicate_keys(sheets, ["slug", "locale"]).select("slug", "locale", F.lit("slug_repeated").alias("violation"))
    blocks = sheets.select("slug", "locale", F.explode("sections.id").alias("block"))
    twice = duplicate_keys(blocks, ["locale", "block"]).select("locale", "block")
    block_repeated = blocks.join(twice, ["locale", "block"], "left_semi").select("slug", "locale", F.lit("block_repeated").alias("violation")).distinct()
    clash = conflicting(sheets.select("slug", "locale", F.inline("sources")), "id").select("id")
    source_conflict = (
        sheets.select("slug", "locale", F.explode("sources.id").alias("id")).join(clash, "id", "left_semi")
        .select("slug", "locale", F.lit("source_conflict").alias("violation")).distinct()
    )
    return own.unionByName(repeated).unionByName(block_repeated).unionByName(source_conflict)


def conflicting(rows: DataFrame, key: str, ignore: tuple[str, ...] = ("slug", "locale")) -> DataFrame:
    """Keys whose rows differ in content."""
    content = [c for c in sorted(rows.columns) if c not in ignore]
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    per = rows.groupBy(key).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b"))
    return per.where("_a <> _b").select(key)


def sorted_fields(value: Column, dtype: T.DataType, drop: dict[str, tuple[str, ...]] | None = None, path: str = "") -> Column:
    """The value with the fields of every struct in name order, less the dropped ones.

    ``drop`` maps a path (dots, arrays transparent) to the fields left out there.
    """
    drop = drop or {}
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: sorted_fields(v, dtype.elementType, drop, path))
    if not isinstance(dtype, T.StructType):
        return value
    kept = sorted((f for f in dtype.fields if f.name not in drop.get(path, ())), key=lambda f: f.name)
    inner = [sorted_fields(value[f.name], f.dataType, drop, f"{path}.{f.name}".lstrip(".")).alias(f.name) for f in kept]
    return F.when(value.isNotNull(), F.struct(*inner))


# What a review of the source text does not depend on.
_OPERATIONAL = {
    "review": ("reviewer", "reviewed_at"),
    "sections.review": ("reviewer", "reviewed_at"),
    "sources": ("accessed_at", "verified_at"),
    "further_reading": ("reviewer", "reviewed_at"),
}
_CONTENT = [
    "common_roles", "description", "family_slug", "further_reading", "image", "kind", "name", "review", "sections", "slug",
    "sound_production", "sources", "text_citations",
]


def source_revision(sheets: DataFrame, legacy: bool = False) -> Column:
    """SHA-256 of the reviewed content of a sheet. The legacy form keeps the review fields."""
    drop = {} if legacy else _OPERATIONAL
    fields = [sorted_fields(F.col(c), sheets.schema[c].dataType, drop, c).alias(c) for c in _CONTENT]
    schema = [] if legacy else [F.lit(2).alias("revision_schema")]
    return F.sha2(F.to_json(F.struct(*fields, *schema), {"ignoreNullFields": "false"}), 256)


def revised(sheets: DataFrame) -> DataFrame:
    """Source sheets get their revision; translations of another revision become stale,
    unless deprecated. A legacy digest is upgraded only when it matches exactly."""
    current = sheets.where(F.col("locale") == SOURCE_LOCALE).withColumns({"_now": source_revision(sheets), "_legacy": source_revision(sheets, legacy=True)})
    known = current.select("slug", "_now", "_legacy")
    joined = sheets.join(known, "slug")
    is_source = F.col("locale") == SOURCE_LOCALE
    upgraded = F.when(is_source | (F.col("source_revision") == F.col("_legacy")), F.col("_now")).otherwise(F.col("source_revision"))
    stale = ~is_source & ~F.col("source_revision").eqNullSafe(F.col("_now")) & (F.col("status") != "deprecated")
    return joined.withColumn("source_revision", upgraded).withColumn("status", F.when(stale, "stale").otherwise(F.col("status"))).select(*sheets.columns)


def carry_withdrawn(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Translations of the previous release that are absent now go on as deprecated."""
    keys = ["kind", "slug", "locale"]
    gone = previous.join(current.select(*keys), keys, "left_anti").withColumn("status", F.lit("deprecated"))
    return current.unionByName(gone, allowMissingColumns=True)


def deprecate_unlisted(blocks: DataFrame, listed: DataFrame, subjects: DataFrame) -> DataFrame:
    """Curiosity blocks of the published subjects that are no longer listed lose their support."""
    ours = blocks.join(subjects.select("subject_slug").distinct().withColumn("_s", F.lit(True)), "subject_slug", "left")
    known = ours.join(listed.select("block_id").distinct().withColumn("_l", F.lit(True)), "block_id", "left")
    drop = F.coalesce("_s", F.lit(False)) & F.col("_l").isNull() & (F.col("section_kind") == "curiosity")
    return known.withColumns(
        {"status": F.when(drop, "deprecated").otherwise(F.col("status")), "claim_support_verified": F.when(drop, F.lit(False)).otherwise(F.col("claim_support_verified"))}
    ).select(*blocks.columns)


def public_content(sheets: DataFrame) -> DataFrame:
    """What readers get: eligible, cited, verified blocks and reviewed readings."""
    def shown(b: Column) -> Column:
        unverified = F.exists(b["citations"], lambda c: ~F.exists("sources", lambda s: (s["id"] == c["source_id"]) & F.coalesce(s["metadata_verified"], F.lit(False))))
        supported = F.coalesce(b["review"]["claim_support_verified"], F.lit(False))
        return b["status"].isin("sourced", "reviewed", "published") & supported & (F.size(b["citations"]) > 0) & ~unverified

    readings = F.filter("further_reading", lambda r: r["status"].isin("reviewed", "published"))
    return sheets.select(
        "kind", "slug", "locale", "family_slug", "name", "description", "sound_production", "common_roles", "sources", "image",
        F.filter("sections", shown).alias("sections"),
        F.transform(readings, lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["publisher"].alias("publisher"))).alias("further_reading"),
    )


def split_sheets(sheets: DataFrame) -> dict[str, DataFrame]:
    """Sheets to neutral entities, sources and localized texts."""
    base = sheets.where(F.col("locale") == SOURCE_LOCALE)
    entities = base.select(
        "kind", "slug", "family_slug", "text_citations", "further_reading",
        F.transform("sources", lambda s: s["id"]).alias("source_ids"),
        F.transform("sections", lambda b: F.struct(b["id"].alias("id"), b["kind"].alias("kind"), b["content_type"].alias("content_type"), b["citations"].alias("citations"))).alias("blocks"),
        F.col("image.asset_id").alias("asset_id"),
    )
    # Of sheets that describe a source differently, the least description by content.
    described = base.select(F.inline("sources"))
    sources = described.groupBy("id").agg(F.min(F.struct(*[c for c in described.columns if c != "id"])).alias("_least")).select("id", "_least.*")
    texts = sheets.select(
        "slug", "locale", "name", "description", "sound_production", "common_roles", "image", "review", "status", "source_revision",
        F.transform("sections", lambda b: F.struct(b["id"].alias("id"), b["text"].alias("text"), b["status"].alias("status"), b["review"].alias("review"))).alias("texts"),
    )
    return {"entities": entities, "sources": sources, "texts": texts}


def expand_sheets(parts: dict[str, DataFrame]) -> DataFrame:
    """Entities, sources and texts back to sheets. A sheet holds few sources and blocks."""
    listed = (
        parts["entities"].select("slug", F.posexplode("source_ids").alias("_i", "id")).join(parts["sources"], "id")
        .groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("_i", F.struct(*_sheet()["sources"].dataType.elementType.names).alias("_s")))).alias("_sources"))
    )
    joined = parts["texts"].join(parts["entities"], "slug").join(listed, "slug", "left")

    def block(t: Column) -> Column:
        found = F.get(F.filter("blocks", lambda b: b["id"] == t["id"]), 0)
        return F.struct(
            t["id"].alias("id"), F.coalesce(found["kind"], F.lit("curiosity")).alias("kind"), t["text"].alias("text"),
            F.coalesce(found["content_type"], F.lit("editorial_summary")).alias("content_type"), t["status"].alias("status"),
            F.coalesce(found["citations"], F.array().cast("array<struct<source_id: string, locator: string, note: string>>")).alias("citations"), t["review"].alias("review"),
        )

    empty = F.array().cast(_sheet()["sources"].dataType)
    return joined.withColumns(
        {"sections": F.transform("texts", block), "sources": F.coalesce(F.transform("_sources", lambda s: s["_s"]), empty)}
    ).select(*_sheet().names)


def snapshot_faults(parts: dict[str, DataFrame]) -> DataFrame:
    """(fault, key) of a split snapshot that cannot be expanded."""
    entities, sources, texts = parts["entities"], parts["sources"], parts["texts"]
    found = [
        (duplicate_keys(entities, ["slug"]), "slug", "duplicate_entity"),
        (duplicate_keys(sources, ["id"]), "id", "duplicate_source"),
        (duplicate_keys(texts, ["locale", "slug"]), "slug", "duplicate_translation"),
        (dangling(texts, entities, "slug", "slug"), "slug", "unknown_entity"),
        (dangling(entities.select(F.explode("source_ids").alias("id")), sources, "id", "id"), "id", "unknown_source"),
        (dangling(entities, texts.where(F.col("locale") == SOURCE_LOCALE), "slug", "slug"), "slug", "no_source_text"),
        (texts.where(_false(F.col("status").isin(*TRANSLATION_STATUSES))), "slug", "translation_status"),
        (texts.where((F.col("locale") != SOURCE_LOCALE) & _false(F.col("source_revision").rlike("^[a-f0-9]{64}$"))), "slug", "source_revision"),
        (texts.where(_false(F.col("locale").rlike("^[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?$"))), "locale", "locale"),
    ]
    out = None
    for df, key, fault in found:
        rows = df.select(F.lit(fault).alias("fault"), F.col(key).alias("key")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out
