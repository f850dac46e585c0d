"""Queries over listening histories: lookups, track profile, vocabulary, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn
from ..config import NATURES, RECORDING_STATUSES
from ..operators import families as fa
from ..operators import listening as ls
from ..operators import report as rp
from ..operators import studies as st
from ..operators import vocabulary as vo
from ..session import shared_folder, stored
from .bridge import SNAPSHOT, Tables
from .oracle import big, div, half_up, weight
from .q_evidence import _served_aliases
from .registry import query


def _tracks(t: Tables) -> DataFrame:
    """Histories with keys; here a track's id already is its recording's."""
    return t.built("tracks", lambda t: ls.with_keys(t.view("history")).withColumn("recording_mbid", F.col("mbid")))


def _profiles(t: Tables) -> DataFrame:
    return t.built("profiles", lambda t: fa.recording_profiles(t.view("layer")))


def _profiled(t: Tables) -> DataFrame:
    return t.built("profiled", lambda t: fa.profile_tracks(_tracks(t), _profiles(t)))


def _states(t: Tables) -> DataFrame:
    return ls.known_statuses(t.view("recording_state"))


def _with_status(t: Tables) -> DataFrame:
    return t.built("with_status", lambda t: fa.with_status(_profiled(t), _states(t)))


def _coverage(t: Tables) -> DataFrame:
    return t.built("coverage", lambda t: fa.coverage(_profiled(t)))


def _names(t: Tables) -> fa.Names:
    """The taxonomy names its subjects; layers of a subject carry the same name."""
    return fa.Names.of(t.view("subject"))


def _presence(t: Tables) -> DataFrame:
    return t.built("presence", lambda t: fa.family_presence(_profiled(t), _names(t)))


def _balance(t: Tables) -> DataFrame:
    return t.built("balance", lambda t: fa.sound_balance(_profiled(t)))


def _discovery(t: Tables) -> DataFrame:
    return t.built("discovery", lambda t: fa.discovery(_profiled(t), names=_names(t)))


def _temper(t: Tables) -> DataFrame:
    return t.built("temper", lambda t: fa.temperament(_profiled(t), _presence(t), _balance(t)))


def _sections(t: Tables) -> DataFrame:
    # All sections read the same sums, which are written once.
    p = fa.TrackProfile.of(stored(fa.listener_facts(_profiled(t)), "facts"))
    return fa.section_states(p.covered, p.balance, p.found, p.tempers)


# ---- identity, keys, lookups

@query("g02_track_keys", "SELECT listener, mbid, artist_key, title_key, replace(track_key, chr(1), '|') AS track_key FROM o_tracks")
def keys(t: Tables) -> DataFrame:
    return _tracks(t).select("listener", "mbid", "artist_key", "title_key", F.replace("track_key", F.lit("\x00"), F.lit("|")).alias("track_key"))


@query("c11_identity_resolution", """
    SELECT listener, h.track_mbid, coalesce(a.recording_mbid, h.track_mbid) AS recording_mbid FROM history h
    LEFT JOIN (SELECT DISTINCT track_mbid, recording_mbid FROM o_alias WHERE recording_mbid IN (SELECT recording_mbid FROM o_evidence)) a ON a.track_mbid = h.track_mbid""")
def identity(t: Tables) -> DataFrame:
    tracks = t.view("history").withColumn("mbid", F.col("track_mbid")).select("listener", "mbid")
    return ls.resolve_identity(tracks, _served_aliases(t, packed=True), packed=True).select("listener", F.col("mbid").alias("track_mbid"), "recording_mbid")


@query("c12_evidence_lookup", f"""
    WITH wanted AS (SELECT DISTINCT listener AS request_id, track_mbid FROM history),
    found AS (SELECT DISTINCT track_mbid, recording_mbid FROM o_alias), hit AS (SELECT request_id, a.track_mbid, f.recording_mbid IS NOT NULL AS h,
      coalesce(f.recording_mbid, a.track_mbid) AS recording_mbid FROM wanted a LEFT JOIN found f ON f.track_mbid = a.track_mbid),
    rec AS (SELECT DISTINCT request_id, recording_mbid FROM hit), art AS (SELECT DISTINCT listener AS request_id, artist_mbid FROM history WHERE artist_mbid IS NOT NULL)
    SELECT x.request_id, CAST(x.tracks AS BIGINT) AS tracks, CAST(x.aliases AS BIGINT) AS aliases, CAST(coalesce(s.n, 0) AS BIGINT) AS recording_statuses,
           CAST(coalesce(c.n, 0) AS BIGINT) AS recording_claims, CAST(coalesce(r.artists, 0) AS BIGINT) AS artists, CAST(coalesce(r.states, 0) AS BIGINT) AS artist_statuses,
           CAST(coalesce(v.n, 0) AS BIGINT) AS vocabulary_rows
    FROM (SELECT request_id, count(*) AS tracks, count(*) FILTER (h) AS aliases FROM hit GROUP BY 1) x
    LEFT JOIN (SELECT request_id, count(*) AS n FROM rec JOIN (SELECT * FROM recording_state WHERE status <> 'unknown') USING (recording_mbid) GROUP BY 1) s USING (request_id)
    LEFT JOIN (SELECT request_id, count(*) AS n FROM rec JOIN layer USING (recording_mbid) GROUP BY 1) c USING (request_id)
    LEFT JOIN (SELECT request_id, count(*) AS artists, count(z.artist_mbid) AS states FROM art LEFT JOIN (SELECT * FROM artist_state WHERE status <> 'unknown') z USING (artist_mbid) GROUP BY 1) r USING (request_id)
    LEFT JOIN (SELECT request_id, count(*) AS n FROM art JOIN vocabulary_row USING (artist_mbid) GROUP BY 1) v USING (request_id)""")
def lookup(t: Tables) -> DataFrame:
    from .q_evidence import _aliases

    history = t.view("history")
    return ls.lookup_counts(
        history.select(F.col("listener").alias("request_id"), "track_mbid"), _aliases(t), _states(t), t.view("layer"),
        history.where("artist_mbid is not null").select(F.col("listener").alias("request_id"), "artist_mbid"), ls.known_statuses(t.view("artist_state")), t.view("vocabulary_row"),
    )


@query("b08_status_whitelist", "SELECT status, CAST(count(*) AS BIGINT) AS recordings FROM recording_state WHERE status IN ('pending', 'complete', 'complete_empty', 'failed') GROUP BY 1")
def whitelist(t: Tables) -> DataFrame:
    return _states(t).groupBy("status").agg(F.count(F.lit(1)).alias("recordings"))


@query("d32_profile_totals", "SELECT listener, period, CAST(count(*) AS BIGINT) AS tracks_analyzed, CAST(sum(play_count) AS BIGINT) AS total_plays FROM history GROUP BY 1, 2")
def totals(t: Tables) -> DataFrame:
    return ls.profile_totals(t.view("history"))


@query("d32_empty_histories", "SELECT c_custkey AS listener FROM customer WHERE c_custkey NOT IN (SELECT listener FROM history)")
def empty(t: Tables) -> DataFrame:
    return ls.empty_histories(t.table("customer").select(F.col("c_custkey").alias("listener")), t.view("history"))


@query("e10_first_artist_names", "SELECT listener, period, artist_mbid, arg_min(artist, rank) AS name FROM history WHERE artist_mbid IS NOT NULL GROUP BY 1, 2, 3")
def first_names(t: Tables) -> DataFrame:
    return ls.first_artist_names(t.view("history"))


@query("e13_canonical_order", """
    SELECT listener, period, CAST(position AS BIGINT) AS position, artist_key, title_key, mbid FROM (
      SELECT *, row_number() OVER (PARTITION BY listener, period ORDER BY artist_key, title_key, coalesce(mbid, '')) AS position FROM o_tracks)""")
def order(t: Tables) -> DataFrame:
    return ls.canonical_order(_tracks(t)).select("listener", "period", F.col("position").cast("bigint").alias("position"), "artist_key", "title_key", "mbid")


# ---- track profile

_COVERAGE = "listener, period, total_tracks, total_plays, covered_tracks, covered_plays, total_artists, covered_artists, coverage_tracks, coverage_plays"


@query("d10_coverage", f"SELECT {_COVERAGE} FROM o_coverage")
def coverage(t: Tables) -> DataFrame:
    return _coverage(t).select(*_COVERAGE.split(", "))


@query("d11_status_counts", f"SELECT listener, period, {', '.join(f'''CAST(count(*) FILTER (recording_status = '{s}') AS BIGINT) AS {s}''' for s in RECORDING_STATUSES)} FROM o_status GROUP BY 1, 2")
def statuses(t: Tables) -> DataFrame:
    return fa.status_counts(_with_status(t))


@query("d12_readiness", "SELECT listener, period, floored AS coverage_floor, ready, status FROM o_gate")
def readiness(t: Tables) -> DataFrame:
    return _coverage(t).select("listener", "period", "coverage_floor", "ready", "status")


@query("d13_vocal_presence", f"""
    SELECT listener, period, CAST(count(*) FILTER (v) AS BIGINT) AS vocal_tracks, count(DISTINCT artist_key) FILTER (v) AS vocal_artists,
           CAST(coalesce(sum(play_count) FILTER (v), 0) AS BIGINT) AS vocal_plays, {half_up(div('count(*) FILTER (v)', 'count(*)'), 4)} AS vocal_track_ratio,
           {half_up(div('coalesce(sum(play_count) FILTER (v), 0)', 'sum(play_count)'), 4)} AS vocal_play_ratio
    FROM (SELECT *, coalesce(mbid IN (SELECT recording_mbid FROM layer WHERE family_slug = 'voice' AND claim_level = 'family' AND confidence = 'documented'), false) AS v FROM o_tracks)
    GROUP BY 1, 2""")
def vocal(t: Tables) -> DataFrame:
    return _coverage(t).select("listener", "period", "vocal_tracks", "vocal_artists", "vocal_plays", "vocal_track_ratio", "vocal_play_ratio")


@query("e01_strongest_layers", "SELECT recording_mbid, family_slug, slug, w AS weight, c AS confidence_weight FROM o_strong")
def strongest(t: Tables) -> DataFrame:
    return fa.strongest_layers(t.view("layer")).select("recording_mbid", "family_slug", "slug", "weight", "confidence_weight")


_PRESENCE = "listener, period, family_rank, family_slug, family_name, share, evidence_count, confidence"


@query("d14_family_presence", f"SELECT {_PRESENCE.replace('family_rank', 'CAST(family_rank AS BIGINT) AS family_rank')} FROM o_presence")
def presence(t: Tables) -> DataFrame:
    return _presence(t).select(*_PRESENCE.split(", ")).withColumn("family_rank", F.col("family_rank").cast("bigint"))


@query("e04_top_families", f"SELECT {_PRESENCE.replace('family_rank', 'CAST(family_rank AS BIGINT) AS family_rank')} FROM o_presence WHERE family_rank <= 3")
def top(t: Tables) -> DataFrame:
    return fa.top_families(_presence(t)).select(*_PRESENCE.split(", ")).withColumn("family_rank", F.col("family_rank").cast("bigint"))


@query("d15_sound_balance", f"SELECT listener, period, balance_available, {', '.join(NATURES)}, unknown, primary_nature FROM o_sound")
def balance(t: Tables) -> DataFrame:
    return _balance(t)


@query("d16_discovery", f"SELECT listener, period, instrument_slug, instrument_name, {big('tracks', 'artists')}, play_share FROM o_discovery")
def discovery(t: Tables) -> DataFrame:
    return _discovery(t)


@query("c18_family_pairs", f"SELECT listener, period, first_family, second_family, {big('shared_tracks')}, shared_plays, {half_up('pair_share', 6)} AS pair_share FROM o_pairs")
def pairs(t: Tables) -> DataFrame:
    return fa.family_pairs(_profiled(t)).withColumn("pair_share", fn.round_half_up(F.col("pair_share"), 6))


@query("f05_shared_tracks", f"SELECT listener, period, {big('shared_tracks')} FROM o_pairs WHERE first_family = 'percussion' AND second_family = 'synthesizers'")
def shared(t: Tables) -> DataFrame:
    both = fa.family_pairs(_profiled(t)).where("first_family = 'percussion' and second_family = 'synthesizers'")
    return both.select("listener", "period", "shared_tracks")


@query("d17_temperament", "SELECT listener, period, rule, primary_family_slug, primary_nature FROM o_temper")
def temper(t: Tables) -> DataFrame:
    return _temper(t)


@query("d18_section_states", "SELECT * FROM o_sections")
def sections(t: Tables) -> DataFrame:
    return _sections(t)


@query("g09_confidence", f"""
    SELECT confidence, {weight('confidence')} AS weight, CAST(count(*) AS BIGINT) AS layers,
           CASE WHEN {weight('confidence')} >= 0.9 THEN 'documented' WHEN {weight('confidence')} >= 0.65 THEN 'strongly_associated' ELSE 'estimated' END AS bucket
    FROM layer GROUP BY 1""")
def confidence(t: Tables) -> DataFrame:
    w = fn.confidence_weight(F.col("confidence"))
    return t.view("layer").groupBy("confidence", w.alias("weight"), fn.confidence_bucket(w).alias("bucket")).agg(F.count(F.lit(1)).alias("layers"))


@query("g12_minimum_tracks", """
    SELECT listener, CAST(least(n, greatest(5, ceil(n * 0.05::DOUBLE))) AS BIGINT) AS needed FROM (SELECT listener, count(*) AS n FROM history GROUP BY 1)""")
def minimum(t: Tables) -> DataFrame:
    return t.view("history").groupBy("listener").agg(F.count(F.lit(1)).alias("n")).select("listener", fn.minimum_tracks(F.col("n"), 0.05, 5).alias("needed"))


@query("d28_cohort_reach", """
    SELECT cohort, CAST(count(*) AS BIGINT) AS tracks, CAST(sum(play_count) AS BIGINT) AS plays,
           """ + ", ".join(
    f"CAST(count(*) FILTER ({flag}) AS BIGINT) AS {name}_tracks, CAST(coalesce(sum(play_count) FILTER ({flag}), 0) AS BIGINT) AS {name}_plays"
    for name, flag in {
        "direct": "d", "direct_or_release": "d OR r", "recurrent": "a", "any_layer": "d OR r OR a", "direct_without_voice": "dx", "any_without_voice": "dx OR rx OR a",
    }.items()
) + """
    FROM (SELECT c_mktsegment AS cohort, play_count, coalesce(mbid IN (SELECT recording_mbid FROM layer), false) AS d,
                 coalesce(mbid IN (SELECT recording_mbid FROM layer WHERE family_slug <> 'voice'), false) AS dx,
                 coalesce(mbid IN (SELECT recording_mbid FROM release_layer), false) AS r,
                 coalesce(mbid IN (SELECT recording_mbid FROM release_layer WHERE family_slug <> 'voice'), false) AS rx,
                 coalesce(artist_mbid IN (SELECT artist_mbid FROM o_rows), false) AS a
          FROM history JOIN customer ON listener = c_custkey) GROUP BY ROLLUP (cohort)""")
def cohorts(t: Tables) -> DataFrame:
    customers = t.table("customer").select(F.col("c_custkey").alias("listener"), F.col("c_mktsegment").alias("cohort"))
    tracks = t.view("history").withColumn("recording_mbid", F.col("mbid")).join(customers, "listener")
    return st.layer_reach(tracks, t.view("layer"), t.view("release_layer"), vo.qualified(t.view("vocabulary_row")))


# ---- vocabulary

def _rows(t: Tables) -> DataFrame:
    return vo.qualified(t.view("vocabulary_row"))


def _plays(t: Tables) -> DataFrame:
    return t.built("plays", lambda t: vo.artist_plays(t.view("history")))


def _scores(t: Tables) -> DataFrame:
    return t.built("scores", lambda t: vo.contributions(_plays(t), _rows(t)))


def _pending(t: Tables) -> DataFrame:
    return t.built("pending", lambda t: ls.unfinished_artists(t.view("history"), t.view("artist_state")))


def _gates(t: Tables) -> DataFrame:
    return t.built("gates", lambda t: vo.vocabulary_gate(_plays(t), _rows(t), t.view("artist_state")))


@query("b10_valid_vocabulary", """
    SELECT artist_mbid, instrument_slug, prevalence, evidence_quality FROM (
      SELECT artist_mbid, instrument_slug, CASE WHEN distinct_recordings > 4 THEN 'NaN'::DOUBLE ELSE prevalence * 2 END AS prevalence, evidence_quality FROM vocabulary_row)
    WHERE NOT isnan(prevalence) AND prevalence <= 1""")
def valid(t: Tables) -> DataFrame:
    odd = F.when(F.col("distinct_recordings") > 4, F.lit(float("nan"))).otherwise(F.col("prevalence") * 2)
    return vo.valid_rows(t.view("vocabulary_row").withColumn("prevalence", odd), strict=False).select("artist_mbid", "instrument_slug", "prevalence", "evidence_quality")


@query("c16_unfinished_artists", "SELECT listener, period, artist_mbid FROM o_pending")
def unfinished(t: Tables) -> DataFrame:
    return _pending(t)


@query("d30_row_deduplication", """
    SELECT artist_mbid, instrument_slug, max(prevalence) AS prevalence, CAST(arg_max(distinct_recordings, prevalence) AS BIGINT) AS distinct_recordings FROM (
      SELECT artist_mbid, instrument_slug, prevalence, distinct_recordings FROM vocabulary_row
      UNION ALL SELECT artist_mbid, instrument_slug, prevalence / 3, distinct_recordings + 1 FROM vocabulary_row) GROUP BY 1, 2""")
def row_dedupe(t: Tables) -> DataFrame:
    rows = t.view("vocabulary_row")
    older = rows.withColumns({"prevalence": F.col("prevalence") / 3, "distinct_recordings": F.col("distinct_recordings") + 1})
    return vo.dedupe_rows(older.unionByName(rows)).select("artist_mbid", "instrument_slug", "prevalence", "distinct_recordings")


@query("e02_best_instruments", "SELECT artist_mbid, family_slug, instrument_slug, prevalence, evidence_quality FROM o_best")
def best(t: Tables) -> DataFrame:
    return vo.best_instruments(_rows(t))


@query("e03_unique_instruments", "SELECT family_slug, instrument_slug, max(prevalence) AS prevalence FROM o_rows GROUP BY 1, 2")
def unique(t: Tables) -> DataFrame:
    return vo.unique_instruments(_rows(t), ["family_slug"]).select("family_slug", "instrument_slug", "prevalence")


_QUALIFIED = "coalesce(artist_mbid IN (SELECT artist_mbid FROM o_rows), false)"


@query("d19_vocabulary_reach", f"""
    SELECT listener, period, {big('total_tracks', 'total_plays', 'total_artists', 'qualified_artists', 'qualified_tracks', 'qualified_plays', 'unresolved_artists', 'unresolved_tracks')},
           {half_up(div('qualified_tracks', 'total_tracks'), 4)} AS track_reach, {half_up(div('qualified_plays', 'total_plays'), 4)} AS play_reach
    FROM (SELECT listener, period, sum(tracks) AS total_tracks, sum(plays) AS total_plays, count(*) AS total_artists, count(*) FILTER (q) AS qualified_artists,
                 coalesce(sum(tracks) FILTER (q), 0) AS qualified_tracks, coalesce(sum(plays) FILTER (q), 0) AS qualified_plays,
                 count(*) FILTER (artist_mbid IS NULL) AS unresolved_artists, coalesce(sum(tracks) FILTER (artist_mbid IS NULL), 0) AS unresolved_tracks
          FROM (SELECT *, {_QUALIFIED} AS q FROM o_plays) GROUP BY 1, 2)""")
def reach(t: Tables) -> DataFrame:
    return vo.reach(_plays(t), _rows(t))


@query("d20_family_scores", f"""
    SELECT f.listener, f.period, CAST(row_number() OVER (PARTITION BY f.listener, f.period ORDER BY {half_up('f.s', 9)} DESC, f.family_slug) AS BIGINT) AS family_rank, f.family_slug, i.family_name,
           {half_up('f.s', 6)} AS score, {half_up(div('f.s', 'sum(f.s) OVER (PARTITION BY f.listener, f.period)'), 6)} AS share, {half_up('i.p', 4)} AS prevalence,
           f.supporting_artists, i.unique_instruments, i.instruments
    FROM (SELECT listener, period, family_slug, sum(score) AS s, count(*) AS supporting_artists FROM o_scores GROUP BY 1, 2, 3) f
    JOIN (SELECT listener, period, family_slug, max(p) AS p, count(*) AS unique_instruments, min(family_name) AS family_name,
                 string_agg(instrument_slug || ':' || documented, ',' ORDER BY instrument_slug) AS instruments
          FROM (SELECT s.listener, s.period, s.family_slug, r.instrument_slug, max(r.prevalence) AS p, min(r.family_name) AS family_name,
                       arg_min(r.documented_recordings, (-r.prevalence, r.artist_mbid)) AS documented
                FROM o_scores s JOIN o_rows r ON r.artist_mbid = s.artist_mbid AND r.family_slug = s.family_slug GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) i
      ON i.listener = f.listener AND i.period = f.period AND i.family_slug = f.family_slug""")
def family_scores(t: Tables) -> DataFrame:
    listed = F.array_join(F.transform("instruments", lambda i: F.concat_ws(":", i["instrument_slug"], i["documented_recordings"])), ",")
    return vo.family_scores(_scores(t), _rows(t)).withColumns({"family_rank": F.col("family_rank").cast("bigint"), "instruments": listed})


@query("d21_concentration", f"SELECT listener, period, {half_up('concentration', 6)} AS concentration FROM o_concentration")
def concentration(t: Tables) -> DataFrame:
    return vo.concentration(_scores(t)).withColumn("concentration", fn.round_half_up(F.col("concentration"), 6))


@query("d22_vocabulary_gate", "SELECT * FROM o_vgate")
def gates(t: Tables) -> DataFrame:
    return _gates(t)


@query("f04_potential_artists", f"""
    SELECT listener, period, artist_mbid FROM o_plays WHERE {_QUALIFIED} UNION SELECT listener, period, artist_mbid FROM o_pending""")
def potential(t: Tables) -> DataFrame:
    known = _plays(t).where("artist_mbid is not null").select(*ls.KEYS, "artist_mbid").join(_rows(t).select("artist_mbid").distinct(), "artist_mbid", "left_semi")
    return vo.potential_artists(known.select(*ls.KEYS, "artist_mbid"), _pending(t))


_RANKED = f"""
    SELECT *, row_number() OVER (PARTITION BY listener, period ORDER BY {half_up('score', 9)} DESC, plays DESC, artist_mbid) AS artist_rank
    FROM (SELECT listener, period, artist_mbid, sum(score) AS score, max(plays) AS plays FROM o_scores GROUP BY 1, 2, 3)"""


@query("e05_ranked_artists", f"SELECT listener, period, CAST(artist_rank AS BIGINT) AS artist_rank, artist_mbid, {half_up('score', 6)} AS score, CAST(plays AS BIGINT) AS plays FROM ({_RANKED}) WHERE artist_rank <= 3")
def ranked(t: Tables) -> DataFrame:
    return vo.ranked_artists(_scores(t)).select("listener", "period", F.col("artist_rank").cast("bigint").alias("artist_rank"), "artist_mbid", fn.round_half_up(F.col("score"), 6).alias("score"), "plays")


@query("d23_featured_artists", f"""
    SELECT k.listener, k.period, CAST(k.artist_rank AS BIGINT) AS artist_rank, k.artist_mbid, n.name,
           string_agg(s.family_slug || ':' || r.names, ';' ORDER BY {half_up('s.score', 9)} DESC, s.family_slug) AS families
    FROM ({_RANKED}) k JOIN o_vgate g ON g.listener = k.listener AND g.period = k.period AND g.status = 'available'
    JOIN o_scores s ON s.listener = k.listener AND s.period = k.period AND s.artist_mbid = k.artist_mbid
    JOIN (SELECT artist_mbid, family_slug, string_agg(instrument_name, ',' ORDER BY prevalence DESC, instrument_name) AS names FROM o_rows GROUP BY 1, 2) r
      ON r.artist_mbid = s.artist_mbid AND r.family_slug = s.family_slug
    JOIN (SELECT listener, period, artist_mbid, arg_min(artist, rank) AS name FROM history WHERE artist_mbid IS NOT NULL GROUP BY 1, 2, 3) n
      ON n.listener = k.listener AND n.period = k.period AND n.artist_mbid = k.artist_mbid
    WHERE k.artist_rank <= 3 GROUP BY 1, 2, 3, 4, 5""")
def featured(t: Tables) -> DataFrame:
    rows = vo.featured_artists(t.view("history"), _scores(t), _rows(t), _gates(t))
    text = F.array_join(F.transform("families", lambda f: F.concat(f["slug"], F.lit(":"), F.array_join(f["instruments"], ","))), ";")
    return rows.select("listener", "period", F.col("artist_rank").cast("bigint").alias("artist_rank"), "artist_mbid", "name", text.alias("families"))


# ---- report

_VIEWS = """
    SELECT g.listener, g.period,
           CASE WHEN g.status IN ('ready', 'partial') AND s.families = 'available' AND v.status = 'available' THEN 'track_palette,artist_vocabulary'
                WHEN g.status IN ('ready', 'partial') AND s.families = 'available' THEN 'track_palette' WHEN v.status = 'available' THEN 'artist_vocabulary' ELSE '' END AS available_views,
           CASE WHEN g.status <> 'insufficient' AND s.families = 'available' THEN 'track_palette' WHEN g.status = 'insufficient' AND v.status = 'available' THEN 'artist_vocabulary' END AS default_view
    FROM o_gate g JOIN o_sections s ON s.listener = g.listener AND s.period = g.period JOIN o_vgate v ON v.listener = g.listener AND v.period = g.period"""


@query("d24_views", _VIEWS)
def views(t: Tables) -> DataFrame:
    # Of the sections, views ask for the families alone.
    return rp.select_views(_coverage(t), fa.families_state(_coverage(t)), _gates(t)).withColumn("available_views", F.array_join("available_views", ","))


@query("e09_hydration_targets", f"SELECT listener, period, kind, target_mbid, {big('rank', 'position')} FROM o_targets")
def targets(t: Tables) -> DataFrame:
    rows = rp.hydration_targets(_with_status(t), _states(t))
    return rows.select("listener", "period", "kind", "target_mbid", F.col("rank").cast("bigint").alias("rank"), F.col("position").cast("bigint").alias("position"))


@query("e09_artist_targets", """
    SELECT listener, period, artist_mbid, rank, row_number() OVER (PARTITION BY listener, period ORDER BY rank, artist_mbid) AS position FROM (
      SELECT p.listener, p.period, p.artist_mbid, CAST(min(h.rank) AS BIGINT) AS rank FROM o_pending p JOIN history h ON h.listener = p.listener AND h.period = p.period AND h.artist_mbid = p.artist_mbid
      GROUP BY 1, 2, 3)""")
def artist_targets(t: Tables) -> DataFrame:
    rows = rp.artist_targets(t.view("history"), t.view("artist_state"))
    return rows.select("listener", "period", "artist_mbid", F.col("rank").cast("bigint").alias("rank"), F.col("position").cast("bigint").alias("position"))


@query("d25_hydration_summary", """
    SELECT h.listener, h.period, CAST(coalesce(r.n, 0) AS BIGINT) AS pending_recordings, CAST(coalesce(a.n, 0) AS BIGINT) AS pending_artists, CAST(coalesce(r.tracks, 0) AS BIGINT) AS pending_aliases,
           CASE WHEN coalesce(r.n, 0) > 0 OR coalesce(a.n, 0) > 0 THEN 'pending' ELSE 'complete' END AS hydration_status
    FROM (SELECT DISTINCT listener, period FROM history) h
    LEFT JOIN (SELECT listener, period, count(*) AS n, count(*) FILTER (kind = 'track') AS tracks FROM o_targets GROUP BY 1, 2) r ON r.listener = h.listener AND r.period = h.period
    LEFT JOIN (SELECT listener, period, count(*) AS n FROM o_pending GROUP BY 1, 2) a ON a.listener = h.listener AND a.period = h.period""")
def summary(t: Tables) -> DataFrame:
    return rp.hydration_summary(ls.profile_totals(t.view("history")), rp.hydration_targets(_with_status(t), _states(t)), _pending(t))


_SOURCES = {"data_source": "catalog", "history_source": "lastfm", "instrumentation_source": "catalog", "image_catalog_version": "1"}


def _reports(t: Tables) -> DataFrame:
    # A third of the plays name a track; its alias leads to the recording.
    named = F.when(F.col("mbid").isNotNull() & (F.col("rank") % 3 == 0), F.col("track_mbid")).otherwise(F.col("mbid"))
    # The id a track is named by is its mbid now; no section asks for another.
    history = t.view("history").withColumn("mbid", named).drop("track_mbid")
    aliases = t.view("history").where("mbid is not null").select("track_mbid", F.col("mbid").alias("recording_mbid")).distinct()
    evidence = rp.Evidence(aliases, t.view("layer"), _states(t), t.view("artist_state"), t.view("vocabulary_row"), _names(t))
    # Tracks and scores are written once; all sections read them.
    return rp.build_reports(history, evidence, SNAPSHOT, path=shared_folder(t.spark, "reports"), sources=_SOURCES)


_BROKEN = [
    "period", "tracks_analyzed", "total_plays", "status", "coverage_tracks", "coverage_plays", "vocal_track_ratio", "vocal_play_ratio", "vocal_counts", "sections", "families", "sound_balance",
    "discovery", "temperament", "temperament_rule", "temperament_nature", "recordings", "reach", "reach_counts", "vocabulary_status", "vocabulary_reason", "concentration", "vocabulary_families",
    "featured_artists", "views", "default_view", "hydration", "profile", "sources",
]


@query("b13_broken_reports", f"""
    SELECT c_custkey AS listener, array_to_string(list_sort([x FOR x IN [CASE WHEN c_acctbal < 0 THEN 'total_plays' END,
           {', '.join(f"CASE WHEN c_custkey % 32 = {i}{' AND c_acctbal >= 0' if name == 'total_plays' else ''} THEN '{name}' END" for i, name in enumerate(_BROKEN))}] IF x IS NOT NULL]), ',') AS violations
    FROM customer""")
def broken_reports(t: Tables) -> DataFrame:
    """One report a customer; its number says which part is spoiled, a debt spoils the plays as well."""
    customers = t.table("customer")
    number = F.col("c_custkey") % 32

    def unless(name: str, good, bad):
        return F.when(number == _BROKEN.index(name), bad).otherwise(good)

    lit, fraction = F.lit, F.lit(0.5)
    family = F.struct(lit("keys").alias("family_slug"), unless("families", F.col("c_mktsegment"), F.repeat(F.col("c_mktsegment"), lit(60))).alias("family_name"), fraction.alias("share"), lit(1).alias("evidence_count"), lit("documented").alias("confidence"))
    recording = F.struct(F.col("c_name").alias("title"), lit("a").alias("artist"), lit(3).alias("play_count"), unless("recordings", lit("resolved"), lit("lost")).alias("status"))
    instrument = F.struct(lit("piano").alias("instrument_name"), lit(3).alias("distinct_recordings"), unless("vocabulary_families", lit("recording"), lit("release")).alias("source_scope"))
    vocabulary_family = F.struct(lit("Keys").alias("family_name"), fraction.alias("share"), lit(2).alias("supporting_artists"), F.array(instrument).alias("instruments"))
    featured = F.struct(lit("m").alias("artist_mbid"), F.col("c_name").alias("name"), F.array(F.struct(lit("keys").alias("slug"), lit("Keys").alias("name"), F.array(unless("featured_artists", lit("piano"), lit(None))).alias("instruments"))).alias("families"))
    states = [unless("sections", lit("available"), lit("maybe")) if n == "discovery" else lit("available") for n in ("families", "sound_balance", "discovery", "temperament")]
    counts = ["qualified_artists", "total_artists", "qualified_tracks", "total_tracks", "qualified_plays", "total_plays", "unresolved_artists", "unresolved_tracks"]
    reports = customers.select(
        F.col("c_custkey").alias("listener"),
        unless("period", lit("overall"), lit("1week")).alias("period"),
        unless("tracks_analyzed", lit(9), lit(201)).alias("tracks_analyzed"),
        unless("total_plays", F.when(F.col("c_acctbal") < 0, lit(-1)).otherwise(lit(7)), lit(-1)).alias("total_plays"),
        F.struct(
            unless("status", lit("ready"), lit("done")).alias("status"), *[unless(n, fraction, lit(1.5)).alias(n) for n in ("coverage_tracks", "coverage_plays", "vocal_track_ratio", "vocal_play_ratio")],
            lit(1).alias("vocal_tracks"), lit(1).alias("vocal_artists"), unless("vocal_counts", lit(1), lit(-1)).alias("vocal_plays"),
        ).alias("analysis"),
        F.struct(*[s.alias(n) for n, s in zip(("families", "sound_balance", "discovery", "temperament"), states, strict=True)]).alias("section_availability"),
        F.array(family).alias("families"),
        F.struct(*[(unless("sound_balance", lit(0.1), lit(-0.1)) if n == "hybrid" else lit(0.1)).alias(n) for n in ("acoustic", "electric", "electronic", "sampled", "hybrid", "unknown")]).alias("sound_balance"),
        F.struct(unless("discovery", lit("piano"), lit(" ")).alias("instrument_slug"), lit("Piano").alias("instrument_name")).alias("discovery"),
        F.struct(unless("temperament_rule", lit("dominant-electric"), lit("dominant-loud")).alias("rule"), unless("temperament", lit("keys"), lit("voice")).alias("primary_family_slug"), unless("temperament_nature", lit("electric"), lit("loud")).alias("primary_nature")).alias("temperament"),
        F.array(recording).alias("recordings"),
        F.struct(unless("reach", fraction, lit(None).cast("double")).alias("track_reach"), fraction.alias("play_reach"), *[(unless("reach_counts", lit(2), lit(-2)) if n == "unresolved_artists" else lit(2)).alias(n) for n in counts]).alias("reach"),
        F.struct(unless("vocabulary_status", lit("available"), lit("ready")).alias("status"), unless("vocabulary_reason", lit("available"), lit(None)).alias("reason"), unless("concentration", fraction, lit(-0.5)).alias("concentration")).alias("vocabulary"),
        F.array(vocabulary_family).alias("vocabulary_families"),
        F.array(featured).alias("featured_artists"),
        F.array(unless("views", lit("track_palette"), lit("all"))).alias("available_views"),
        unless("default_view", lit("track_palette"), lit("all")).alias("default_view"),
        F.struct(lit("pending").alias("hydration_status"), unless("hydration", lit(50), lit(51)).alias("pending_recordings"), lit(200).alias("pending_artists"), lit(0).alias("pending_aliases")).alias("hydration"),
        lit(SNAPSHOT).alias("snapshot_version"), lit("m").alias("methodology_version"), lit("v").alias("vocabulary_methodology"),
        F.struct(unless("profile", F.col("c_name"), F.repeat(F.col("c_name"), lit(9))).alias("username"), *[lit(None).cast("string").alias(n) for n in ("profile_url", "avatar_url", "realname", "registered")]).alias("profile"),
        F.struct(lit("c").alias("catalog_version"), lit("catalog").alias("data_source"), unless("sources", lit("lastfm"), lit("radio")).alias("history_source"), lit("catalog").alias("instrumentation_source"), lit("1").alias("image_catalog_version")).alias("sources"),
    )
    return rp.with_violations(reports).select("listener", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query("b13_report_contract", f"""
    SELECT g.listener, g.period, g.status, CAST(g.total_tracks AS BIGINT) AS tracks, coalesce(p.n, 0) AS families, m.rule, v.status AS vocabulary, '' AS violations, default_view
    FROM o_gate g JOIN ({_VIEWS}) w ON w.listener = g.listener AND w.period = g.period JOIN o_vgate v ON v.listener = g.listener AND v.period = g.period
    LEFT JOIN (SELECT listener, period, CAST(count(*) AS BIGINT) AS n FROM o_presence GROUP BY 1, 2) p ON p.listener = g.listener AND p.period = g.period
    LEFT JOIN o_temper m ON m.listener = g.listener AND m.period = g.period AND g.ready""")
def report(t: Tables) -> DataFrame:
    return rp.with_violations(_reports(t)).select(
        "listener", "period", "analysis.status", F.col("tracks_analyzed").alias("tracks"), F.size("families").cast("bigint").alias("families"), "temperament.rule",
        F.col("vocabulary.status").alias("vocabulary"), F.array_join("violations", ",").alias("violations"), "default_view",
    )
