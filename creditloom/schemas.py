"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DumpTable:
    """A table of the metadata dump: columns picked by position from a text row."""

    name: str
    columns: tuple[tuple[str, int], ...]
    required: bool

    @property
    def width(self) -> int:
        return max(position for _, position in self.columns) + 1


# The dump's tables and the positions of the columns used.
DUMP_TABLES = {
    table.name: table
    for table in (
        DumpTable("artist", (("id", 0), ("gid", 1), ("name", 2)), True),
        DumpTable("artist_credit", (("id", 0), ("name", 1)), False),
        DumpTable("artist_credit_name", (("artist_credit", 0), ("position", 1), ("artist", 2), ("name", 3)), True),
        DumpTable("instrument", (("id", 0), ("gid", 1), ("name", 2)), True),
        DumpTable("link_type", (("id", 0), ("name", 6)), True),
        DumpTable("link", (("id", 0), ("link_type", 1)), True),
        DumpTable("link_attribute_type", (("id", 0), ("gid", 4), ("name", 5)), True),
        DumpTable("link_attribute", (("link", 0), ("attribute_type", 1)), True),
        DumpTable("link_attribute_credit", (("link", 0), ("attribute_type", 1), ("credited_as", 2)), False),
        DumpTable("l_artist_recording", (("link", 1), ("artist", 2), ("recording", 3)), True),
        DumpTable("l_artist_instrument", (("link", 1), ("artist", 2), ("instrument", 3)), False),
        DumpTable("l_artist_release", (("link", 1), ("artist", 2), ("release", 3)), False),
        DumpTable("recording", (("id", 0), ("gid", 1), ("title", 2), ("artist_credit", 3)), True),
        DumpTable("medium", (("id", 0), ("release", 1)), False),
        DumpTable("release", (("id", 0), ("gid", 1), ("title", 2), ("artist_credit", 3)), False),
        DumpTable("track", (("gid", 1), ("recording", 2), ("medium", 3)), True),
    )
}

# Columns of the dump that hold row numbers and those that must hold text.
ID_COLUMNS = {
    "artist": ("id",),
    "instrument": (),
    "link_type": ("id",),
    "link": ("id", "link_type"),
    "link_attribute_type": ("id",),
    "link_attribute": ("link", "attribute_type"),
    "link_attribute_credit": ("link", "attribute_type"),
    "l_artist_recording": ("link", "artist", "recording"),
    "l_artist_release": ("link", "artist", "release"),
    "recording": ("id",),
    "medium": ("id", "release"),
    "release": ("id",),
    "track": ("recording", "medium"),
}
TEXT_COLUMNS = {
    "artist": ("gid", "name"),
    "instrument": ("gid", "name"),
    "link_type": ("name",),
    "link_attribute_type": ("name",),
    "recording": ("gid", "title"),
    "release": ("gid", "title"),
    "track": ("gid",),
}
OPTIONAL_TEXT_COLUMNS = {"link_attribute_type": ("gid",), "link_attribute_credit": ("credited_as",)}


# Schemas as DDL: they need no running session until they are used.
EVIDENCE = (
    "recording_mbid string, recording_title string, release_mbid string, release_title string, "
    "artist_mbid string, performer string, instrument_mbid string, instrument_name string, "
    "attributes array<string>, original_credit string, scope string, relation_type string, "
    "production_method string, source_url string, snapshot_version string"
)
ALIAS = ("track_mbid string, recording_mbid string, source_url string, snapshot_version string")
VOCABULARY = (
    "artist_mbid string, artist_name string, instrument_mbid string, instrument_name string, "
    "distinct_recordings bigint, documented_recordings bigint, prevalence double, qualifying boolean, "
    "snapshot_version string"
)
CLAIM = (
    "instrument_mbid string, instrument_name string, attributes array<string>, scope string, "
    "source_url string, source_urls array<string>, relation_type string, production_method string, "
    "credit_count bigint, performer_count bigint"
)
ARTIST_ENTRY = (
    "instrument_mbid string, instrument_name string, distinct_recordings bigint, "
    "documented_recordings bigint, prevalence double, qualifying boolean"
)
_ENVELOPE = "schema_version string, snapshot_version string, shard string, part bigint, parts bigint, "
SHARDS = {
    "recording": (
        _ENVELOPE + "records map<string, struct<recording_mbid: string, source_url: string, "
        f"claims: array<struct<{CLAIM}>>>>"
    ),
    "track": (_ENVELOPE + "aliases map<string, string>"),
    "artist": (
        _ENVELOPE + "artists map<string, struct<artist_mbid: string, artist_name: string, "
        f"entries: array<struct<{ARTIST_ENTRY}>>>>"
    ),
}
MANIFEST = (
    "schema_version string, snapshot_version string, generated_at string, source_url string, "
    "license string, attribution string, parent_hash string, object_prefix string, "
    "recording_count bigint, credit_count bigint, manifest_hash string, "
    "tables map<string, struct<rows: bigint, bytes: bigint, digest: string, lanes: array<string>>>, "
    "counters map<string, bigint>"
)
HISTORY = (
    "listener string, period string, rank bigint, title string, artist string, play_count bigint, "
    "mbid string, artist_mbid string, release_mbid string, url string"
)
LAYER = (
    "recording_mbid string, slug string, name string, family_slug string, family_name string, "
    "nature string, confidence string, prominence double, claim_level string"
)
VOCABULARY_ROW = (
    "artist_mbid string, instrument_slug string, instrument_name string, family_slug string, "
    "family_name string, distinct_recordings bigint, documented_recordings bigint, prevalence double, "
    "evidence_quality double, source_scope string"
)
SNAPSHOT = (
    "snapshot_version string, index_schema_version string, manifest_hash string, record_count bigint, "
    "credit_count bigint, status string, generated_at string, published_at timestamp, "
    "created_at timestamp, object_prefix string, methodology_version string"
)
JOB = (
    "id bigint, snapshot_version string, target_kind string, target_mbid string, shard_key string, "
    "status string, attempts bigint, last_error string, next_attempt_at timestamp, "
    "created_at timestamp, updated_at timestamp"
)
