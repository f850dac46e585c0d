"""Listening-service payloads to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Policy
from ..functions import bounded_text, canonical_mbid, http_url, media_url, once, profile_url, registered_iso, strip, within_bounds
from ..functions.numbers import MAX_SAFE_INTEGER


def _is_type(value: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(name), F.lit(False))


def _as_text(value: Column, limit: int = 512) -> Column:
    """Bounded text of a variant; a number or an object is not text."""
    return F.when(_is_type(value, "STRING"), once(strip(F.try_variant_get(value, "$", "string")), lambda text: within_bounds(text, limit)))


def _play_count(value: Column) -> Column:
    """A whole number given as a number or as text; blank text counts as zero."""
    def whole(number: Column) -> Column:
        return F.when((number >= 0) & (number <= MAX_SAFE_INTEGER) & (number == F.floor(number)), number.cast("bigint"))

    text = F.trim(F.try_variant_get(value, "$", "string"))
    return once(text, lambda t: once(F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double")), whole))


_TRACK = "struct<name: variant, playcount: variant, mbid: variant, artist: variant, album: variant, url: variant>"
_ARTIST = "struct<name: variant, mbid: variant>"


def _lost(value: Column, name: str) -> Column:
    """Why a text is missing: longer than its bound, or not there."""
    given = _is_type(value, "STRING") & (F.trim(F.try_variant_get(value, "$", "string")) != "")
    return F.when(given, f"{name}_too_long").otherwise(f"missing_{name}")


def _checked_track(track: Column) -> Column:
    """The columns of a track, and why it is rejected; every value is taken from its variant once."""
    def judged(v: Column) -> Column:
        t, person, name = v["t"], v["person"], v["name"]
        values = F.struct(
            _as_text(t["name"]).alias("title"),
            _as_text(name, 256).alias("artist"),
            _play_count(t["playcount"]).alias("play_count"),
            canonical_mbid(_as_text(t["mbid"]), strict=True).alias("mbid"),
            canonical_mbid(_as_text(person["mbid"]), strict=True).alias("artist_mbid"),
            canonical_mbid(_as_text(F.try_variant_get(t["album"], "$.mbid", "variant")), strict=True).alias("release_mbid"),
            http_url(_as_text(t["url"], 2048)).alias("url"),
        )
        return once(values, lambda c: F.struct(
            *[c[n].alias(n) for n in ("title", "artist", "play_count", "mbid", "artist_mbid", "release_mbid", "url")],
            F.when(c["title"].isNull(), _lost(t["name"], "title")).when(c["artist"].isNull(), _lost(name, "artist"))
            .when(c["play_count"].isNull(), "invalid_play_count").alias("reason"),
        ))

    def with_artist(t: Column) -> Column:
        # A cast tells an object from a text by its head.
        person = F.try_variant_get(t["artist"], "$", _ARTIST)
        named = once(person, lambda p: F.struct(
            t.alias("t"), p.alias("person"), F.when(p.isNotNull(), p["name"]).otherwise(t["artist"]).alias("name"),
        ))
        return once(named, judged)

    return once(F.try_variant_get(track, "$", _TRACK), with_artist)


def check_pages(pages: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Every track of top-track pages, with the reason it is rejected for; null for none.

    ``pages`` has listener, period, page (from 1) and payload (JSON text). A payload that is
    no history page, or holds more tracks than a page, is one row without a rank; so no page
    fails the job, and the array that is exploded is bounded.

    A page is one expression, in which each value is named once; its tracks are judged before
    they are exploded, so a filter on their reasons judges none again.
    """
    def of(v: Column) -> Column:
        tracks = F.try_variant_get(v, "$.toptracks.track", "variant")
        many = F.try_variant_get(v, "$.toptracks.track", "array<variant>")
        # Casts tell lists and objects apart by their head; naming a type would walk every track of the page.
        single = once(tracks, lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(F.array().cast("array<variant>")))
        user = F.try_variant_get(v, "$.toptracks['@attr'].user", "variant")

        def checked(items: Column) -> Column:
            fault = F.when(F.try_variant_get(v, "$.toptracks", "struct<track: variant>").isNull(), "not_a_history_page").when(
                F.size(items) > policy.page_size, "page_too_large"
            )
            # A page with a fault goes on as one empty track.
            return once(fault, lambda f: F.struct(
                _as_text(user, 64).alias("user"), f.alias("fault"),
                F.transform(F.when(f.isNull(), items).otherwise(F.array(F.lit(None).cast("variant"))), _checked_track).alias("tracks"),
            ))

        return once(F.coalesce(many, single), checked)

    parsed = pages.withColumn("_p", once(F.try_parse_json("payload"), of))
    # The outer form takes no filter on the size of its list, which would make the list a second time.
    rows = parsed.select(
        F.coalesce("_p.user", "listener").alias("listener"), "period", "page", F.col("_p.fault").alias("_fault"), F.posexplode_outer("_p.tracks").alias("_i", "_t")
    ).where("_i is not null")
    return rows.select(
        "listener",
        "period",
        "page",
        F.when(F.col("_fault").isNull(), (F.col("page") - 1) * policy.page_size + F.col("_i") + 1).cast("bigint").alias("rank"),
        *[F.col(f"_t.{n}").alias(n) for n in ("title", "artist", "play_count", "mbid", "artist_mbid", "release_mbid", "url")],
        F.coalesce("_fault", "_t.reason").alias("reject_reason"),
    )


def parse_pages(pages: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ranked rows that ``check_pages`` accepts."""
    return check_pages(pages, policy).where("reject_reason is null").drop("page", "reject_reason")


def page_rejects(pages: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Rejected rows per listener, period and reason."""
    return check_pages(pages, policy).where("reject_reason is not null").groupBy("listener", "period", "reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def parse_profiles(profiles: DataFrame) -> DataFrame:
    """Profile payloads (listener, payload) to one row per listener.

    Every value is a column before it is judged, so it is taken from its payload once.
    """
    v = F.col("_v")
    user = "$.profile"

    def string_of(value: Column) -> Column:
        return F.when(_is_type(value, "STRING"), F.try_variant_get(value, "$", "string"))

    image = F.col("_image")
    images = F.when(_is_type(image, "ARRAY"), F.try_variant_get(image, "$", "array<variant>")).otherwise(F.array(image))
    links = F.transform(
        images,
        lambda i: F.coalesce(string_of(i), F.try_variant_get(i, "$['#text']", "string"), F.try_variant_get(i, "$.url", "string")),
    )
    values = profiles.withColumn("_v", F.try_parse_json("payload")).select(
        "listener",
        F.try_variant_get(v, f"{user}.image", "variant").alias("_image"),
        F.try_variant_get(v, "$.username", "variant").alias("_username"),
        F.try_variant_get(v, f"{user}.realname", "variant").alias("_realname"),
        F.try_variant_get(v, f"{user}.url", "string").alias("_url"),
        F.try_variant_get(v, f"{user}.registered.unixtime", "string").alias("_unixtime"),
        F.coalesce(
            F.try_variant_get(v, f"{user}.registered['#text']", "string"),
            F.try_variant_get(v, f"{user}.registered.text", "string"),
        ).alias("_registered"),
    )
    texts = values.withColumns({"_links": links, "_username": string_of(F.col("_username")), "_realname": string_of(F.col("_realname"))})
    named = texts.withColumn("username", F.coalesce(bounded_text(F.col("_username"), 64), F.col("listener")))
    accepted = F.filter(F.transform("_links", media_url), lambda u: u.isNotNull())
    return named.select(
        "listener",
        "username",
        profile_url(F.col("_url"), F.col("username")).alias("profile_url"),
        F.try_element_at(accepted, F.lit(-1)).alias("avatar_url"),
        bounded_text(F.col("_realname"), 256).alias("realname"),
        registered_iso(F.col("_unixtime"), F.col("_registered")).alias("registered"),
    )
