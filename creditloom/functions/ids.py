"""Identifiers, digests and shard keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

__all__ = [
    "canonical_mbid",
    "packed_id",
    "unpacked_id",
    "valid_slug",
    "shard_width",
    "shard_key",
    "shard_number",
    "performer_identity",
    "source_url",
    "content_digest",
    "reading_id",
    "uuid_of",
    "sorted_sources",
    "first_source",
]

_LOOSE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z"
_STRICT = "^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\\z"
# Longer than a packed id, so that the two forms differ in length.
_MARK = "ff" * 17
_SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"


def canonical_mbid(c: Column, strict: bool = False) -> Column:
    """Trimmed lower-case id, or null. ``strict`` also checks version and variant.

    ``c`` is named once, so what it is computed from is not computed again.
    """
    return F.get(F.regexp_extract_all(F.lower(strip(c)), F.lit(_STRICT if strict else _LOOSE), F.lit(0)), F.lit(0))


def packed_id(c: Column) -> Column:
    """The sixteen bytes of a canonical id; any other text goes on whole behind a mark.

    Ids are random text, which no codec shortens: packed, they take half the room in a shuffle.
    Two texts are equal if and only if their packed forms are.
    """
    return F.when(c.rlike(_LOOSE), F.unhex(F.replace(c, F.lit("-"), F.lit("")))).otherwise(F.concat(F.unhex(F.lit(_MARK)), c.cast("binary")))


def unpacked_id(c: Column) -> Column:
    """The text that ``packed_id`` was made of."""
    laid = F.lower(F.hex(c))
    for at in (9, 14, 19, 24):
        laid = F.overlay(laid, F.lit("-"), at, 0)
    return F.when(F.octet_length(c) == 16, laid).otherwise(F.substr(c, F.lit(len(_MARK) // 2 + 1)).cast("string"))


def valid_slug(c: Column, limit: int = 80) -> Column:
    text = strip(c)
    return F.when((F.length(text) <= limit) & text.rlike(_SLUG), text)


def shard_width(shards: int) -> int:
    """Hex digits of a shard name; the count must be a power of sixteen."""
    width = (shards.bit_length() - 1) // 4
    if not 1 <= width <= 8 or 16**width != shards:
        raise ValueError(f"{shards} shards do not make a whole number of hex digits (1 to 8)")
    return width


def shard_key(mbid: Column, width: int) -> Column:
    return F.substring(F.lower(strip(mbid)), 1, width)


def shard_number(mbid: Column, width: int) -> Column:
    return F.conv(shard_key(mbid, width), 16, 10).cast("bigint")


def performer_identity(artist_mbid: Column, performer: Column) -> Column:
    by_name = F.concat(F.lit("name:"), F.lower(strip(performer)))
    return F.coalesce(F.concat(F.lit("mbid:"), artist_mbid), by_name)


def source_url(kind: str, mbid: Column) -> Column:
    """Public page of a recording, release or track."""
    return F.concat(F.lit(f"https://musicbrainz.org/{kind}/"), mbid)


def content_digest(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the named columns, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def reading_id(kind: Column, slug: Column, title: Column, url: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", kind, slug, title, url), 256)
    return F.concat(
        F.lit("editorial-"), kind, F.lit("-"), slug, F.lit("-reading-"), F.substring(digest, 1, 16)
    )


def uuid_of(text: Column) -> Column:
    """A deterministic id laid out like an MBID."""
    digest = F.md5(text)
    return F.concat_ws(
        "-", *[F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )


def sorted_sources(urls: Column) -> Column:
    """Sorted distinct non-blank URLs."""
    return F.array_sort(F.array_distinct(F.filter(urls, lambda u: strip(u) != "")))


def first_source(urls: Column) -> Column:
    return F.array_min(F.filter(urls, lambda u: strip(u) != ""))
