"""Evidence to deduplicated credits, claims, aliases and vocabularies ready to serve."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, PLACEHOLDER_ARTIST_MBIDS, PLACEHOLDER_ARTIST_NAMES, Policy
from ..functions import canonical_mbid, content_digest, or_default, packed_id, performer_identity, source_url, strip, unpacked_id
from ..sources.dump import union_all
from . import evidence as ev

CREDIT_IDENTITY = [
    "artist_mbid", "instrument_mbid", "instrument_name", "attributes", "scope", "relation_type",
    "production_method", "performer",
]
CLAIM_IDENTITY = ["instrument_mbid", "instrument_name", "attributes", "scope", "relation_type", "production_method"]


def _filled(c: Column) -> Column:
    """Null for blank text."""
    return F.when(strip(c) != "", c)


def is_placeholder(artist_mbid: Column, artist_name: Column) -> Column:
    name = F.coalesce(F.lower(strip(artist_name)), F.lit(""))
    return artist_mbid.isin(*PLACEHOLDER_ARTIST_MBIDS) | name.isin(*PLACEHOLDER_ARTIST_NAMES)


def union_evidence(direct: DataFrame, release: DataFrame | None) -> DataFrame:
    return direct if release is None else union_all([direct, release])


def _normal_credit() -> dict[str, Column]:
    """Normalized columns of evidence that follow from its link alone."""
    name = strip(F.col("instrument_name"))
    trimmed = F.filter(F.transform("attributes", lambda a: strip(a)), lambda a: a != "")
    attributes = F.array_union(F.coalesce(trimmed, F.array().cast("array<string>")), F.array(name))
    return {
        "instrument_mbid": canonical_mbid(F.col("instrument_mbid")),
        "instrument_name": name,
        "attributes": F.array_sort(attributes),
        "relation_type": F.lower(or_default(F.col("relation_type"), "instrument")),
        "production_method": or_default(F.col("production_method"), "performed"),
        "original_credit": _filled(F.col("original_credit")),
    }


def _unresolved() -> Column:
    return (F.col("relation_type") == "instrument") & F.col("instrument_mbid").isNull()


def _nameless() -> Column:
    return F.coalesce(F.col("instrument_name"), F.lit("")) == ""


def judge_evidence(evidence: DataFrame, snapshot_version: str) -> DataFrame:
    """Normalized evidence with a ``reject_reason``; a row of another snapshot fails the job."""
    foreign = F.coalesce(F.col("snapshot_version"), F.lit("")) != ""
    foreign = foreign & (F.col("snapshot_version") != snapshot_version)
    credit = _normal_credit()
    normalized = evidence.select(
        F.when(foreign, F.raise_error(F.concat(F.lit("snapshot mismatch: found "), F.col("snapshot_version"))).cast("string"))
        .otherwise(canonical_mbid(F.col("recording_mbid"))).alias("recording_mbid"),
        canonical_mbid(F.col("artist_mbid")).alias("artist_mbid"),
        credit["instrument_mbid"].alias("instrument_mbid"),
        credit["instrument_name"].alias("instrument_name"),
        credit["attributes"].alias("attributes"),
        or_default(F.col("scope"), "recording").alias("scope"),
        credit["relation_type"].alias("relation_type"),
        credit["production_method"].alias("production_method"),
        _filled(F.col("performer")).alias("performer"),
        credit["original_credit"].alias("original_credit"),
        _filled(F.col("source_url")).alias("source_url"),
    )
    reason = (
        F.when(F.col("recording_mbid").isNull(), "invalid_evidence")
        .when(_unresolved(), "unresolved_instrument")
        .when(_nameless(), "invalid_evidence")
        .when(~F.col("scope").isin("recording", "release"), "invalid_evidence")
    )
    return normalized.withColumn("reject_reason", reason)


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("reject_reason is null").drop("reject_reason")


def prefer_direct(evidence: DataFrame) -> DataFrame:
    """Release evidence stays only where its recording has no direct evidence."""
    direct = evidence.where("scope <> 'release'")
    release = evidence.where("scope = 'release'")
    return direct.unionByName(release.join(direct.select("recording_mbid").distinct(), "recording_mbid", "left_anti"))


def dump_evidence(tables: dict[str, DataFrame], relations: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Accepted evidence of a dump, release evidence only for recordings without direct: the rows
    that ``prefer_direct`` leaves of the accepted rows of ``direct_evidence`` and ``release_context``.

    Texts are judged on the links, recordings and artists, before joins repeat them. Recordings
    with direct evidence leave before releases fan out. ``keep`` may write the links' credits,
    which are read three times.
    """
    credits = ev.link_credits(relations)
    credits = keep(credits.select("link", *[c.alias(name) for name, c in _normal_credit().items()]).where(~_unresolved() & ~_nameless()))
    recordings = tables["recording"].select(F.col("id").alias("recording"), canonical_mbid(F.col("gid")).alias("recording_mbid"), "gid")
    recordings = recordings.where("recording_mbid is not null")
    artists = tables["artist"].select(
        F.col("id").alias("artist"), canonical_mbid(F.col("gid")).alias("artist_mbid"), _filled(F.col("name")).alias("performer")
    )
    credited = ev.supported_credits(tables, "l_artist_recording", credits).select("recording").distinct()
    direct = recordings.join(credited, "recording", "left_semi").select("recording_mbid")
    rest = recordings.drop("gid").join(direct, "recording_mbid", "left_anti")

    def shaped(rows: DataFrame, scope: str, page: Column) -> DataFrame:
        return rows.select(
            "recording_mbid", "artist_mbid", "instrument_mbid", "instrument_name", "attributes", F.lit(scope).alias("scope"),
            "relation_type", "production_method", "performer", "original_credit", page.alias("source_url"),
        )

    own = shaped(ev.direct_rows(tables, credits, recordings, artists), "recording", source_url("recording", F.col("gid")))
    context = shaped(ev.release_rows(tables, credits, rest, artists), "release", source_url("release", F.col("release_mbid")))
    return own.unionByName(context)


def dedupe_credits(evidence: DataFrame) -> DataFrame:
    """One credit per identity (nulls are equal), with its first source.

    The other sources stay rows (``credit_sources``): a popular credit may have very
    many, and no single row has to hold them.
    """
    return evidence.groupBy("recording_mbid", *CREDIT_IDENTITY).agg(F.min("source_url").alias("source_url"))


def credit_sources(evidence: DataFrame) -> DataFrame:
    keys = ["recording_mbid", *CREDIT_IDENTITY, "source_url"]
    return evidence.where("source_url is not null").select(*keys).distinct()


def aggregate_claims(credits: DataFrame) -> DataFrame:
    """Credits to claims: credit count, distinct performers, first source.

    Performers are grouped first, so the count needs no set of performers. Credits are
    distinct already, so a claim has no more rows than performers and original credits.
    """
    keys = ["recording_mbid", *CLAIM_IDENTITY]
    # Dealt once by part of a claim's key: both groupings then need no further shuffle.
    credits = credits.repartition("recording_mbid", "instrument_mbid", "relation_type")
    per_performer = credits.withColumn("_who", performer_identity(F.col("artist_mbid"), F.col("performer")))
    per_performer = per_performer.groupBy(*keys, "_who").agg(
        F.count(F.lit(1)).alias("_credits"), F.min("source_url").alias("source_url")
    )
    return per_performer.groupBy(*keys).agg(
        F.sum("_credits").alias("credit_count"),
        F.count("_who").alias("performer_count"),
        F.min("source_url").alias("source_url"),
    )


def claim_sources(evidence: DataFrame) -> DataFrame:
    """Distinct sources of each claim, one row each."""
    keys = ["recording_mbid", *CLAIM_IDENTITY, "source_url"]
    return evidence.where("source_url is not null").select(*keys).distinct()


def judge_aliases(aliases: DataFrame) -> DataFrame:
    ids = aliases.select(
        canonical_mbid(F.col("track_mbid")).alias("track_mbid"), canonical_mbid(F.col("recording_mbid")).alias("recording_mbid")
    )
    valid = F.col("track_mbid").isNotNull() & F.col("recording_mbid").isNotNull()
    return ids.withColumn("reject_reason", F.when(~valid, "invalid_alias"))


def servable_aliases(aliases: DataFrame, servable: DataFrame) -> DataFrame:
    """Aliases whose recording is served."""
    return aliases.join(servable.select("recording_mbid").distinct(), "recording_mbid", "left_semi")


def unique_aliases(aliases: DataFrame, packed: bool = False) -> DataFrame:
    """One recording per track; a track with two fails the build. With ``packed`` the ids stay packed.

    A track has few aliases: they are dealt by track first, as a partial minimum and maximum
    would send each recording twice.
    """
    rows = aliases.select(packed_id(F.col("track_mbid")).alias("track_mbid"), packed_id(F.col("recording_mbid")).alias("_r")).repartition("track_mbid")
    clash = F.raise_error(F.concat(F.lit("more than one recording claims track "), unpacked_id(F.col("track_mbid")))).cast("binary")
    unique = rows.groupBy("track_mbid").agg(F.min("_r").alias("_low"), F.max("_r").alias("_high")).select(
        "track_mbid", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(clash).alias("recording_mbid")
    )
    return unique if packed else unique.select(*[unpacked_id(F.col(c)).alias(c) for c in unique.columns])


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Tracks that name more than one recording."""
    pairs = aliases.select("track_mbid", "recording_mbid").distinct()
    return pairs.groupBy("track_mbid").agg(F.count(F.lit(1)).alias("recordings")).where("recordings > 1")


def judge_vocabulary(vocabulary: DataFrame) -> DataFrame:
    artist = canonical_mbid(F.col("artist_mbid"))
    rows = vocabulary.withColumn("artist_mbid", artist).withColumn("instrument_mbid", canonical_mbid(F.col("instrument_mbid")))
    reason = (
        F.when(F.col("artist_mbid").isNull(), "invalid_vocabulary")
        .when(is_placeholder(F.col("artist_mbid"), F.col("artist_name")), "special_artist")
        .when(F.col("instrument_mbid").isNull(), "invalid_vocabulary")
    )
    return rows.withColumn("reject_reason", reason)


def dedupe_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """One row per artist and instrument, the one of greatest prevalence."""
    rest = ["prevalence", "distinct_recordings", "documented_recordings", "qualifying", "instrument_name", "artist_name"]
    best = vocabulary.groupBy("artist_mbid", "instrument_mbid").agg(F.max(F.struct(*rest)).alias("_best"))
    return best.select("artist_mbid", "instrument_mbid", "_best.*")


def recording_documents(claims: DataFrame, sources: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """(key, value) rows for the recording shards, each with lists of bounded length.

    Sources and claims are counted while they are flat. A claim with very many sources is
    listed once per part of them; a recording with very many claims goes on under its id, a
    hash sign and the number of the part. Readers put parts together again.
    """
    identity = ["recording_mbid", *CLAIM_IDENTITY]
    keyed = claims.withColumn("_k", content_digest(*identity))
    loose = sources.select(content_digest(*identity).alias("_k"), "source_url").distinct()
    lists = F.ceil(F.count(F.lit(1)) / policy.list_part_rows).cast("bigint")
    loose = loose.join(loose.groupBy("_k").agg(lists.alias("_lists")), "_k").withColumn("_list", F.pmod(F.xxhash64("source_url"), F.col("_lists")))
    listed = loose.groupBy("_k", "_list").agg(F.array_sort(F.collect_list("source_url")).alias("_sources"))
    flat = keyed.join(listed, "_k", "left")
    pieces = flat.groupBy("recording_mbid").agg(lists.alias("_pieces"))
    flat = flat.join(pieces, "recording_mbid").withColumn("_piece", F.pmod(F.xxhash64("_k", "_list"), F.col("_pieces")))
    value = F.struct(
        "instrument_mbid", "instrument_name", "attributes", "scope",
        F.get("_sources", F.lit(0)).alias("source_url"),
        F.when(F.size("_sources") > 1, F.col("_sources")).alias("source_urls"),
        "relation_type", "production_method", "credit_count", "performer_count",
    )
    order = ["instrument_mbid", "instrument_name", "scope", "relation_type", "production_method", "attributes", "_list"]
    gathered = flat.select("recording_mbid", "_piece", F.struct(*order, value.alias("claim")).alias("_c")).groupBy("recording_mbid", "_piece")
    documents = gathered.agg(F.transform(F.array_sort(F.collect_list("_c")), lambda c: c["claim"]).alias("claims"))
    url = source_url("recording", F.col("recording_mbid")).alias("source_url")
    name = F.when(F.col("_piece") == 0, F.col("recording_mbid")).otherwise(F.concat_ws("#", "recording_mbid", "_piece"))
    return documents.select(name.alias("key"), F.struct("recording_mbid", url, "claims").alias("value"))


def artist_documents(vocabulary: DataFrame) -> DataFrame:
    """(key, value) rows for the artist shards; entries are bounded by the instrument table."""
    entry = F.struct("instrument_mbid", "instrument_name", "distinct_recordings", "documented_recordings", "prevalence", "qualifying")
    grouped = vocabulary.groupBy("artist_mbid").agg(F.max("artist_name").alias("artist_name"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return grouped.select(F.col("artist_mbid").alias("key"), F.struct("artist_mbid", "artist_name", "entries").alias("value"))


def alias_documents(aliases: DataFrame) -> DataFrame:
    return aliases.select(F.col("track_mbid").alias("key"), F.col("recording_mbid").alias("value"))


@dataclass(frozen=True)
class Serving:
    evidence: DataFrame
    judged: DataFrame
    credits: DataFrame
    claims: DataFrame
    judged_aliases: DataFrame
    aliases: DataFrame
    judged_vocabulary: DataFrame
    vocabulary: DataFrame


def serve(
    direct: DataFrame, release: DataFrame | None, aliases: DataFrame, vocabulary: DataFrame, snapshot_version: str,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> Serving:
    """Everything that is served. ``keep`` may write the judged evidence, which several results start from."""
    judged = keep(judge_evidence(union_evidence(direct, release), snapshot_version))
    evidence = prefer_direct(accepted(judged))
    # What release evidence gives way to is of the same recording: accepted rows name the recordings served.
    credits = dedupe_credits(evidence)
    claims = aggregate_claims(credits)
    judged_aliases = judge_aliases(aliases)
    judged_vocabulary = judge_vocabulary(vocabulary)
    return Serving(
        evidence=evidence,
        judged=judged,
        credits=credits,
        claims=claims,
        judged_aliases=judged_aliases,
        aliases=unique_aliases(servable_aliases(accepted(judged_aliases), accepted(judged))),
        judged_vocabulary=judged_vocabulary,
        vocabulary=dedupe_vocabulary(accepted(judged_vocabulary)),
    )


def _reasons(judged: DataFrame, *reasons: str) -> list[Column]:
    return [F.count_if(F.col("reject_reason") == r).alias(f"discarded_{r}_rows") for r in reasons]


def stage_counters(s: Serving) -> DataFrame:
    """One row with every count of the serving stage.

    Claims and aliases become one row a recording each, stacked and grouped once: which
    aliases are served, and which are orphans, follows from a recording's row, and rejected
    aliases are counted on the way. So claims, and the evidence behind them, are evaluated
    once, the evidence once more for its rejects, and aliases once.
    """
    evidence = s.judged.agg(
        F.count(F.lit(1)).alias("input_evidence_rows"), *_reasons(s.judged, "unresolved_instrument", "invalid_evidence")
    )
    claimed = s.claims.groupBy("recording_mbid").agg(
        F.sum("credit_count").alias("credits"), F.count(F.lit(1)).alias("claims"), F.bool_or(F.col("scope") == "release").alias("fallback")
    )
    bad = F.col("reject_reason").isNotNull()
    named = s.judged_aliases.groupBy("recording_mbid", F.when(~bad, F.col("track_mbid")).alias("track_mbid"), bad.alias("_bad"))
    named = named.agg(F.count(F.lit(1)).alias("rows")).groupBy("recording_mbid").agg(
        F.count_if(~F.col("_bad")).alias("tracks"), F.sum(F.when(~F.col("_bad"), F.col("rows"))).alias("rows"),
        F.sum(F.when(F.col("_bad"), F.col("rows"))).alias("bad"),
    )
    both = claimed.unionByName(named, allowMissingColumns=True).groupBy("recording_mbid").agg(
        *[F.sum(c).alias(c) for c in ("credits", "claims", "tracks", "rows", "bad")], F.bool_or("fallback").alias("fallback")
    )
    served = F.col("claims").isNotNull()
    recordings = both.agg(
        F.count_if(served).alias("recording_count"),
        F.coalesce(F.sum("credits"), F.lit(0)).alias("credit_count"),
        F.coalesce(F.sum("claims"), F.lit(0)).alias("claim_count"),
        F.count_if("fallback").alias("release_fallback_recordings"),
        F.coalesce(F.sum(F.when(served, F.col("tracks"))), F.lit(0)).alias("alias_count"),
        F.coalesce(F.sum(F.when(~served, F.col("rows"))), F.lit(0)).alias("orphan_alias_count"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("discarded_invalid_alias_rows"),
    )
    kept = F.col("reject_reason").isNull()
    vocabulary = s.judged_vocabulary.agg(
        F.count_if(kept).alias("vocabulary_entries"),
        F.count_if(kept & F.col("qualifying")).alias("qualifying_vocabulary_entries"),
        *_reasons(s.judged_vocabulary, "invalid_vocabulary", "special_artist"),
    )
    # One row per part, stacked; each count has its one value.
    stacked = union_all([evidence, recordings, vocabulary])
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
