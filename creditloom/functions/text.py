"""Names, bounded text, URLs, locales."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

__all__ = [
    "once",
    "strip",
    "bounded_text",
    "within_bounds",
    "fold_name",
    "http_url",
    "on_hosts",
    "hex_color",
    "media_url",
    "profile_url",
    "ascii_alias",
    "decompose_alias",
    "with_normalized_alias",
    "match_locale",
    "or_default",
]

# Hosts that serve accepted avatars, and the profile hosts.
AVATAR_HOSTS = (
    "lastfm-img.freetls.fastly.net",
    "lastfm.freetls.fastly.net",
    "lastfm-img2.akamaized.net",
)
PROFILE_HOSTS = ("www.last.fm", "last.fm")

# White space as the web platform trims it: ASCII, the no-break and wide spaces, the BOM.
_SPACES = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_SPACE_CHARS = "".join(map(chr, _SPACES))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it; also inside lambdas."""
    return F.get(F.transform(F.array(value), then), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE_CHARS))


def bounded_text(c: Column, limit: int = 512) -> Column:
    """Trimmed text, or null when empty, over-long or holding a NUL."""
    return within_bounds(strip(c), limit)


def within_bounds(text: Column, limit: int = 512) -> Column:
    """Text that is trimmed already, or null as ``bounded_text`` has it."""
    # Two bytes per UTF-16 unit: characters outside the basic plane count twice.
    units = F.octet_length(F.encode(text, "UTF-16BE"))
    return F.when((units > 0) & (units <= 2 * limit) & ~text.contains("\x00"), text)


def or_default(c: Column, default: str) -> Column:
    """Trimmed text, or the default when null or blank."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def fold_name(c: Column) -> Column:
    """Case- and space-insensitive form of a name."""
    # Every kind of space becomes a plain one; only names with a run of them meet a regex.
    plain = F.translate(F.lower(c), _SPACE_CHARS, " " * len(_SPACE_CHARS))
    single = F.when(plain.contains("  "), F.regexp_replace(plain, " +", " ")).otherwise(plain)
    return F.trim(single)


def http_url(c: Column, limit: int = 2048) -> Column:
    """The URL when it is http(s), has a host and carries no credentials."""
    def judged(text: Column) -> Column:
        scheme = F.lower(F.try_parse_url(text, F.lit("PROTOCOL")))
        host = F.try_parse_url(text, F.lit("HOST"))
        user = F.try_parse_url(text, F.lit("USERINFO"))
        return F.when(scheme.isin("http", "https") & host.isNotNull() & user.isNull(), text)

    return once(bounded_text(c, limit), judged)


def on_hosts(url: Column, hosts: tuple[str, ...]) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts)


def hex_color(c: Column) -> Column:
    return F.when(c.rlike("^#[0-9a-fA-F]{6}$"), c)


def media_url(c: Column) -> Column:
    """An avatar URL: https, an accepted host, the image path."""
    def judged(url: Column) -> Column:
        https = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
        path = F.try_parse_url(url, F.lit("PATH"))
        return F.when(https & on_hosts(url, AVATAR_HOSTS) & path.startswith("/i/u/"), url)

    return once(http_url(c), judged)


def profile_url(c: Column, username: Column) -> Column:
    """The given profile URL when it is the user's own, else the canonical one."""
    def own(url: Column, name: Column) -> Column:
        path = F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/")
        return (
            (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https")
            & on_hosts(url, PROFILE_HOSTS)
            & once(
                F.filter(path, lambda x: x != ""),
                lambda parts: (F.lower(F.get(parts, 0)) == "user") & (F.lower(F.try_url_decode(F.get(parts, 1))) == F.lower(name)),
            )
        )

    def chosen(name: Column) -> Column:
        # url_encode writes forms ('+'); a path needs '%20'.
        made = F.concat(F.lit("https://www.last.fm/user/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))
        given = once(http_url(c), lambda url: F.when(F.coalesce(own(url, name), F.lit(False)), url))
        return F.when(name.isNotNull(), F.coalesce(given, made))

    return once(bounded_text(username, 64), chosen)


def ascii_alias(c: Column) -> Column:
    """Alias form of pure ASCII text: lower case, every other run one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


class _Classes(dict):
    """A translation table that classifies each character once."""

    def __init__(self, classify) -> None:
        super().__init__()
        self.classify = classify

    def __missing__(self, code: int):
        self[code] = value = self.classify(code, unicodedata.category(chr(code))[0])
        return value


_WITHOUT_MARKS = _Classes(lambda code, group: None if group == "M" else code)
_WORDS_ONLY = _Classes(lambda code, group: code if group in "LN" else " ")


def _decompose(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text).translate(_WITHOUT_MARKS).lower()
    return " ".join(plain.translate(_WORDS_ONLY).split())


@F.pandas_udf(T.StringType())
def decompose_alias(names: pd.Series) -> pd.Series:
    """Alias form of any text; Spark has no Unicode decomposition, hence Arrow batches.

    A name that repeats within a batch is decomposed once.
    """
    known: dict[str | None, str | None] = {None: None} | {name: _decompose(name) for name in names.dropna().unique()}
    return pd.Series([known[name] for name in names], dtype=object)


def with_normalized_alias(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the alias form of a name column: a plain projection, without a join or a shuffle.

    ASCII names are normalized in the JVM; Python sees nulls in their place.
    """
    is_ascii = F.col(source).rlike(r"^[\x00-\x7F]*$")
    return df.withColumn(target, F.when(is_ascii, ascii_alias(F.col(source))).otherwise(decompose_alias(F.when(~is_ascii, F.col(source)))))


def match_locale(c: Column, supported: tuple[str, ...], fallbacks: dict[str, str]) -> Column:
    """Canonical tag when supported, else the language's fallback, else null."""
    parts = F.split(strip(c), "-")
    tail = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda p: F.when(F.length(p) == 4, F.initcap(p)).when(F.length(p) == 2, F.upper(p)).otherwise(F.lower(p)),
    )
    tag = F.concat_ws("-", F.array(F.lower(F.get(parts, 0))), tail)
    language = F.lower(F.get(parts, 0))
    found = F.when(tag.isin(*supported), tag)
    for name, target in fallbacks.items():
        found = F.coalesce(found, F.when(language == name, F.lit(target)))
    return found
