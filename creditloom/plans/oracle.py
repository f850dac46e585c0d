"""Shared steps of the DuckDB texts, built on the bridge views."""

from __future__ import annotations

_SUPPORTED = "('instrument', 'vocal', 'vocals', 'programming', 'samples', 'sampled')"


def _method(c: str) -> str:
    return f"CASE WHEN {c} = 'programming' THEN 'programmed' WHEN {c} IN ('samples', 'sampled') THEN 'sampled' ELSE 'performed' END"


def half_up(x: str, places: int) -> str:
    scale = f"{float(10**places)!r}::DOUBLE"
    return f"(floor(({x}) * {scale} + 0.500000001::DOUBLE) / {scale})"


def weight(c: str) -> str:
    return f"CASE {c} WHEN 'documented' THEN 1.0::DOUBLE WHEN 'strongly_associated' THEN 0.75::DOUBLE WHEN 'estimated' THEN 0.45::DOUBLE END"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


def big(*columns: str) -> str:
    """Columns as BIGINT; DuckDB sums of integers are wider."""
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


NATURES = ("acoustic", "electric", "electronic", "sampled", "hybrid")
FOLD = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"

SHARED: dict[str, str] = {
    "o_typed": f"""
        SELECT l.id AS link, lower(t.name) AS relation_type FROM d_link l JOIN d_link_type t ON l.link_type = t.id
        WHERE lower(t.name) IN {_SUPPORTED}""",
    "o_credited": """
        SELECT link, attribute_type, max(credited_as) AS credited FROM d_link_attribute_credit
        WHERE credited_as <> '' GROUP BY link, attribute_type""",
    "o_attr": """
        SELECT a.link, a.attribute_type, y.name AS attribute_name, i.gid AS instrument_mbid, i.name AS instrument_name, c.credited
        FROM d_link_attribute a JOIN d_link_attribute_type y ON a.attribute_type = y.id
        LEFT JOIN d_instrument i ON i.gid = y.gid
        LEFT JOIN o_credited c ON c.link = a.link AND c.attribute_type = a.attribute_type""",
    "o_relation": """
        SELECT t.link, t.relation_type, list_sort(list(DISTINCT attribute_name) FILTER (attribute_name IS NOT NULL)) AS attributes,
               string_agg(DISTINCT instrument_mbid, '|' ORDER BY instrument_mbid) AS instruments, max(credited) AS credited
        FROM o_typed t LEFT JOIN o_attr a ON a.link = t.link GROUP BY t.link, t.relation_type""",
    "o_fan": """
        SELECT r.link, r.relation_type, r.credited, x.instrument_mbid,
               coalesce(x.instrument_name, CASE WHEN r.relation_type IN ('vocal', 'vocals') THEN 'voice' ELSE r.relation_type END) AS instrument_name,
               r.attributes AS plain
        FROM o_relation r
        LEFT JOIN (SELECT DISTINCT link, instrument_mbid, instrument_name FROM o_attr WHERE instrument_mbid IS NOT NULL) x ON x.link = r.link
        WHERE r.relation_type <> 'instrument' OR x.instrument_mbid IS NOT NULL""",
    "o_named": f"""
        SELECT link, relation_type, instrument_mbid, instrument_name, coalesce(credited, instrument_name) AS original_credit,
               array_to_string(list_sort(list_distinct(list_append(coalesce(plain, []::VARCHAR[]), instrument_name))), '|') AS attributes,
               {_method('relation_type')} AS production_method
        FROM o_fan""",
    "o_direct": """
        SELECT c.artist, c.recording, r.gid AS recording_mbid, r.title AS recording_title, a.gid AS artist_mbid, a.name AS performer,
               n.instrument_mbid, n.instrument_name, n.attributes, n.original_credit, 'recording' AS scope, n.relation_type,
               n.production_method, 'https://musicbrainz.org/recording/' || r.gid AS source_url
        FROM d_l_artist_recording c JOIN o_named n ON c.link = n.link JOIN d_recording r ON r.id = c.recording
        LEFT JOIN d_artist a ON a.id = c.artist""",
    "o_bridge": """
        SELECT DISTINCT m.release, t.recording FROM d_track t JOIN d_medium m ON t.medium = m.id
        WHERE m.release IN (SELECT c.release FROM d_l_artist_release c JOIN o_typed y ON c.link = y.link)""",
    "o_release": """
        SELECT r.gid AS recording_mbid, r.title AS recording_title, e.gid AS release_mbid, e.title AS release_title, a.gid AS artist_mbid,
               a.name AS performer, n.instrument_mbid, n.instrument_name, n.attributes, n.original_credit, 'release' AS scope,
               n.relation_type, n.production_method, 'https://musicbrainz.org/release/' || e.gid AS source_url
        FROM d_l_artist_release c JOIN o_named n ON c.link = n.link JOIN d_release e ON e.id = c.release
        JOIN o_bridge b ON b.release = c.release JOIN d_recording r ON r.id = b.recording LEFT JOIN d_artist a ON a.id = c.artist""",
    "o_relevant": """
        SELECT recording FROM o_bridge
        UNION SELECT c.recording FROM d_l_artist_recording c JOIN o_typed y ON c.link = y.link""",
    "o_alias": """
        SELECT t.gid AS track_mbid, r.gid AS recording_mbid FROM d_track t JOIN o_relevant v ON t.recording = v.recording
        JOIN d_recording r ON r.id = t.recording""",
    "o_vocabulary": """
        SELECT o.artist_mbid, o.artist_name, o.instrument_mbid, o.instrument_name, o.n AS distinct_recordings, d.n AS documented_recordings,
               o.n::DOUBLE / d.n::DOUBLE AS prevalence, o.n >= 3 AS qualifying
        FROM (SELECT artist, max(artist_mbid) AS artist_mbid, max(performer) AS artist_name, instrument_mbid,
                     max(instrument_name) AS instrument_name, count(DISTINCT recording) AS n
              FROM o_direct WHERE instrument_mbid IS NOT NULL GROUP BY artist, instrument_mbid) o
        JOIN (SELECT artist, count(DISTINCT recording) AS n FROM o_direct GROUP BY artist) d ON o.artist = d.artist""",
    "o_evidence": """
        SELECT recording_mbid, artist_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method,
               performer, source_url FROM o_direct
        UNION ALL
        SELECT recording_mbid, artist_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method,
               performer, source_url FROM o_release WHERE recording_mbid NOT IN (SELECT recording_mbid FROM o_direct)""",
    "o_credits": """
        SELECT recording_mbid, artist_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method,
               performer, min(source_url) AS source_url
        FROM o_evidence GROUP BY ALL""",
    "o_claims": """
        SELECT recording_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method,
               count(*) AS credit_count,
               count(DISTINCT coalesce('mbid:' || artist_mbid, 'name:' || lower(trim(performer)))) AS performer_count,
               min(source_url) AS source_url
        FROM o_credits GROUP BY ALL""",
    # The taxonomy subjects the bridge's instrument names map to.
    "o_subject": """SELECT * FROM (VALUES
        ('electric guitar', 'instrument', 'electric-guitar', 'plucked-strings'), ('drums (drum set)', 'instrument', 'drums', 'percussion'),
        ('synthesizer', 'instrument', 'synthesizer', 'synthesizers'), ('cello', 'instrument', 'cello', 'bowed-strings'),
        ('sampler', 'instrument', 'sampler', 'sampled-sounds'), ('violin', 'family', 'bowed-strings', 'bowed-strings'),
        ('voice', 'family', 'voice', 'voice')) AS v(instrument_name, claim_level, subject_slug, family_slug)""",
    "o_mapped": """
        SELECT recording_mbid, claim_level, subject_slug, CASE WHEN claim_level = 'instrument' THEN subject_slug END AS instrument_slug,
               family_slug, scope, CAST(sum(credit_count) AS BIGINT) AS credit_count, CAST(sum(performer_count) AS BIGINT) AS performer_count,
               min(source_url) AS source_url
        FROM o_claims JOIN o_subject USING (instrument_name) GROUP BY ALL""",
    "o_tracks": f"""
        SELECT *, {FOLD.format('artist')} AS artist_key, {FOLD.format('title')} AS title_key,
               {FOLD.format('artist')} || chr(1) || {FOLD.format('title')} || chr(1) || coalesce(mbid, '') AS track_key FROM history""",
    "o_strong": f"""
        SELECT recording_mbid, family_slug, family_name, w, c, slug FROM (
          SELECT *, prominence * {weight('confidence')} AS w, {weight('confidence')} AS c,
                 row_number() OVER (PARTITION BY recording_mbid, family_slug
                   ORDER BY prominence * {weight('confidence')} DESC, CASE claim_level WHEN 'instrument' THEN 0 ELSE 1 END, slug) AS rn
          FROM layer) WHERE rn = 1""",
    "o_share": """
        SELECT *, w / sum(w) OVER (PARTITION BY recording_mbid) AS share FROM o_strong""",
    "o_covered": """
        SELECT t.* FROM o_tracks t WHERE mbid IN (SELECT recording_mbid FROM layer)""",
    "o_coverage": f"""
        SELECT listener, period, count(*) AS total_tracks, CAST(sum(play_count) AS BIGINT) AS total_plays,
               CAST(count(*) FILTER (covered) AS BIGINT) AS covered_tracks,
               CAST(coalesce(sum(play_count) FILTER (covered), 0) AS BIGINT) AS covered_plays,
               count(DISTINCT artist_key) AS total_artists, count(DISTINCT artist_key) FILTER (covered) AS covered_artists,
               {half_up(div('count(*) FILTER (covered)', 'count(*)'), 4)} AS coverage_tracks,
               {half_up(div('coalesce(sum(play_count) FILTER (covered), 0)', 'sum(play_count)'), 4)} AS coverage_plays
        FROM (SELECT *, coalesce(mbid IN (SELECT recording_mbid FROM layer), false) AS covered FROM o_tracks) GROUP BY listener, period""",
    "o_gate": """
        SELECT *, floored AND covered_artists >= least(total_artists, 2) AS ready,
               CASE WHEN floored AND covered_artists >= least(total_artists, 2) THEN 'ready' WHEN covered_tracks > 0 THEN 'partial'
                    ELSE 'insufficient' END AS status
        FROM (SELECT *, coverage_tracks >= 0.05::DOUBLE AND coverage_plays >= 0.05::DOUBLE
                        AND covered_tracks >= least(total_tracks, greatest(5, ceil(total_tracks * 0.05::DOUBLE))) AS floored FROM o_coverage)""",
    "o_family": f"""
        SELECT listener, period, family_slug, min(family_name) AS family_name, sum(play_count * share) AS score, count(DISTINCT track_key) AS evidence_count,
               sum(play_count * share * c) / sum(play_count * share) AS mean
        FROM o_covered JOIN o_share ON mbid = recording_mbid GROUP BY listener, period, family_slug""",
    "o_presence": f"""
        SELECT listener, period, row_number() OVER (PARTITION BY listener, period ORDER BY {half_up('score', 6)} DESC, family_slug) AS family_rank,
               family_slug, family_name, {half_up('score / sum(score) OVER (PARTITION BY listener, period)', 4)} AS share, evidence_count,
               CASE WHEN mean >= 0.9::DOUBLE - 1e-9 THEN 'documented' WHEN mean >= 0.65::DOUBLE - 1e-9 THEN 'strongly_associated' ELSE 'estimated' END AS confidence
        FROM o_family""",
    "o_nature": f"""
        SELECT recording_mbid, nature, sum(share * nw / known) AS part FROM (
          SELECT s.recording_mbid, s.share, n.nature, n.nw, sum(n.nw) OVER (PARTITION BY s.recording_mbid, s.family_slug) AS known
          FROM o_share s JOIN (SELECT recording_mbid, family_slug, nature, sum(prominence * {weight('confidence')}) AS nw
                               FROM layer WHERE nature IS NOT NULL GROUP BY recording_mbid, family_slug, nature) n
            ON s.recording_mbid = n.recording_mbid AND s.family_slug = n.family_slug) GROUP BY recording_mbid, nature""",
    "o_balance": f"""
        SELECT listener, period, total, coalesce(known, 0) >= (0.8::DOUBLE - 1e-9) * total AND total > 0 AS balance_available,
               {', '.join(f"coalesce({n}, 0) AS {n}_score" for n in NATURES)}
        FROM (SELECT listener, period, sum(play_count)::DOUBLE AS total FROM o_covered GROUP BY listener, period)
        LEFT JOIN (SELECT listener, period, sum(play_count * part) AS known,
                     {', '.join(f"sum(play_count * part) FILTER (nature = '{n}') AS {n}" for n in NATURES)}
                   FROM o_covered JOIN o_nature ON mbid = recording_mbid GROUP BY listener, period) USING (listener, period)""",
    "o_sound": f"""
        SELECT listener, period, balance_available, {', '.join(f"CASE WHEN balance_available THEN {half_up(f'{n}_score / total', 4)} END AS {n}" for n in NATURES)},
               CASE WHEN balance_available THEN {half_up('greatest(0.0::DOUBLE, 1 - (' + ' + '.join(half_up(f'{n}_score / total', 4) for n in NATURES) + '))', 4)} END AS unknown,
               list_sort([{', '.join(f"{{'s': {half_up(f'{n}_score', 6)}, 'n': '{n}'}}" for n in NATURES)}])[5].n AS primary_nature
        FROM o_balance""",
    "o_discovery": f"""
        SELECT listener, period, slug AS instrument_slug, name AS instrument_name, tracks, artists, {half_up('share', 6)} AS play_share FROM (
          SELECT *, row_number() OVER (PARTITION BY listener, period ORDER BY share, tracks DESC, artists DESC, slug) AS rn FROM (
            SELECT t.listener, t.period, slug, min(name) AS name, count(DISTINCT track_key) AS tracks, count(DISTINCT artist_key) AS artists,
                   {div('sum(play_count)', 'max(a.total)')} AS share
            FROM o_covered t JOIN (SELECT recording_mbid, slug, min(name) AS name FROM layer WHERE claim_level = 'instrument' GROUP BY recording_mbid, slug) l ON mbid = recording_mbid
            JOIN (SELECT listener, period, sum(play_count) AS total FROM o_covered GROUP BY listener, period) a ON a.listener = t.listener AND a.period = t.period
            GROUP BY t.listener, t.period, slug)
          WHERE tracks >= 3 AND artists >= 2 AND share <= 0.35::DOUBLE) WHERE rn = 1""",
    "o_held": """
        SELECT listener, period, track_key, family_slug, sum(play_count) AS plays FROM o_covered JOIN o_strong ON mbid = recording_mbid
        GROUP BY listener, period, track_key, family_slug""",
    "o_pairs": f"""
        SELECT x.listener, x.period, x.first_family, x.second_family, x.shared_tracks, CAST(x.shared_plays AS BIGINT) AS shared_plays,
               {div('x.shared_plays', 't.total')} AS pair_share
        FROM (SELECT a.listener, a.period, a.family_slug AS first_family, b.family_slug AS second_family, count(*) AS shared_tracks, sum(a.plays) AS shared_plays
              FROM o_held a JOIN o_held b ON a.listener = b.listener AND a.period = b.period AND a.track_key = b.track_key AND a.family_slug < b.family_slug
              GROUP BY ALL) x
        JOIN (SELECT listener, period, sum(play_count) AS total FROM o_covered GROUP BY listener, period) t ON x.listener = t.listener AND x.period = t.period""",
    "o_temper": """
        SELECT f.listener, f.period,
               CASE WHEN f.p >= 0.1::DOUBLE AND f.s >= 0.1::DOUBLE AND coalesce(q.shared_tracks, 0) >= 3 AND coalesce(q.pair_share, 0) >= 0.15::DOUBLE THEN 'recurring-percussion-synthesizers'
                    WHEN f.k >= 0.25::DOUBLE AND b.electric >= 0.25::DOUBLE THEN 'electric-plucked-strings'
                    WHEN b.sampled >= 0.15::DOUBLE THEN 'recurring-sampled' WHEN b.electronic >= 0.25::DOUBLE THEN 'recurring-electronic'
                    ELSE 'dominant-' || b.primary_nature END AS rule, f.primary_family_slug, b.primary_nature
        FROM (SELECT listener, period, coalesce(max(share) FILTER (family_slug = 'percussion'), 0) AS p, coalesce(max(share) FILTER (family_slug = 'synthesizers'), 0) AS s,
                     coalesce(max(share) FILTER (family_slug = 'plucked-strings'), 0) AS k, arg_min(family_slug, family_rank) AS primary_family_slug,
                     list_reverse_sort(list(share) FILTER (evidence_count >= 3))[2] AS second
              FROM o_presence GROUP BY listener, period) f
        JOIN o_sound b ON b.listener = f.listener AND b.period = f.period AND b.balance_available
        LEFT JOIN o_pairs q ON q.listener = f.listener AND q.period = f.period AND q.first_family = 'percussion' AND q.second_family = 'synthesizers'
        WHERE f.second >= 0.1::DOUBLE""",
    "o_sections": """
        SELECT g.listener, g.period,
               CASE WHEN bare THEN missing ELSE 'available' END AS families,
               CASE WHEN bare THEN missing WHEN coalesce(b.balance_available, false) THEN 'available' ELSE 'insufficient_nature_evidence' END AS sound_balance,
               CASE WHEN bare THEN missing WHEN ready AND d.listener IS NOT NULL THEN 'available' ELSE missing END AS discovery,
               CASE WHEN bare THEN missing WHEN ready AND m.listener IS NOT NULL THEN 'available' ELSE missing END AS temperament
        FROM (SELECT *, covered_tracks = 0 AND NOT ready AS bare, CASE WHEN floored THEN 'insufficient_diversity' ELSE 'insufficient_coverage' END AS missing FROM o_gate) g
        LEFT JOIN o_sound b ON b.listener = g.listener AND b.period = g.period
        LEFT JOIN o_discovery d ON d.listener = g.listener AND d.period = g.period
        LEFT JOIN o_temper m ON m.listener = g.listener AND m.period = g.period""",
    "o_rows": "SELECT * FROM vocabulary_row WHERE distinct_recordings >= 3",
    "o_plays": """
        SELECT listener, period, lower(trim(artist_mbid)) AS artist_mbid,
               coalesce(lower(trim(artist_mbid)), 'name:' || trim(lower(artist))) AS artist_id, count(*) AS tracks, sum(play_count) AS plays
        FROM history GROUP BY ALL""",
    "o_totals": "SELECT listener, period, sum(tracks) AS tt, sum(plays) AS tp, count(*) AS ta FROM o_plays GROUP BY listener, period",
    "o_best": """
        SELECT artist_mbid, family_slug, instrument_slug, prevalence, evidence_quality FROM (
          SELECT *, row_number() OVER (PARTITION BY artist_mbid, family_slug ORDER BY prevalence DESC, instrument_slug) AS rn FROM o_rows) WHERE rn = 1""",
    "o_scores": f"""
        SELECT p.listener, p.period, p.artist_mbid, b.family_slug, p.plays,
               least({div('p.plays', 't.tp')}, 0.4::DOUBLE) * b.prevalence * b.evidence_quality AS score
        FROM o_plays p JOIN o_best b ON p.artist_mbid = b.artist_mbid JOIN o_totals t ON t.listener = p.listener AND t.period = p.period""",
    "o_concentration": f"""
        SELECT listener, period, {div('max(s)', 'sum(s)')} AS concentration FROM (
          SELECT listener, period, artist_mbid, sum(score) AS s FROM o_scores GROUP BY ALL) GROUP BY listener, period""",
    "o_pending": """
        SELECT DISTINCT listener, period, artist_mbid FROM o_plays WHERE artist_mbid IS NOT NULL AND artist_mbid NOT IN
          (SELECT artist_mbid FROM artist_state WHERE status IN ('complete', 'complete_empty', 'failed'))""",
    "o_vgate": f"""
        SELECT listener, period,
               CASE WHEN f IS NULL THEN 'available' WHEN hopeful THEN 'pending' ELSE 'insufficient' END AS status,
               CASE WHEN f IS NULL THEN CASE WHEN pa > 0 THEN 'available_with_pending_hydration' ELSE 'available' END
                    WHEN hopeful THEN 'snapshot_hydration_pending' ELSE f END AS reason,
               CAST(pa AS BIGINT) AS pending_artists, {half_up('con', 4)} AS concentration
        FROM (SELECT *, CASE WHEN qa = 0 THEN 'no_mapped_evidence' WHEN {div('qt', 'tt')} < 0.1::DOUBLE THEN 'insufficient_track_reach'
                             WHEN {div('qp', 'tp')} < 0.1::DOUBLE THEN 'insufficient_play_reach' WHEN qa < need THEN 'insufficient_artist_diversity'
                             WHEN con > 0.7::DOUBLE + 1e-9 THEN 'excessive_artist_concentration' END AS f,
                     pa > 0 AND {div('ct', 'tt')} >= 0.1::DOUBLE AND {div('cp', 'tp')} >= 0.1::DOUBLE AND ca >= need AS hopeful
              FROM (SELECT m.listener, m.period, sum(tracks) AS tt, sum(plays) AS tp, least(3, count(*)) AS need,
                           coalesce(sum(tracks) FILTER (q), 0) AS qt, coalesce(sum(plays) FILTER (q), 0) AS qp, count(*) FILTER (q) AS qa,
                           coalesce(sum(tracks) FILTER (q OR w), 0) AS ct, coalesce(sum(plays) FILTER (q OR w), 0) AS cp, count(*) FILTER (q OR w) AS ca,
                           count(*) FILTER (w) AS pa, coalesce(max(c.concentration), 0) AS con
                    FROM (SELECT p.*, coalesce(p.artist_mbid IN (SELECT artist_mbid FROM o_rows), false) AS q, n.artist_mbid IS NOT NULL AS w
                          FROM o_plays p LEFT JOIN o_pending n ON n.listener = p.listener AND n.period = p.period AND n.artist_mbid = p.artist_mbid) m
                    LEFT JOIN o_concentration c ON c.listener = m.listener AND c.period = m.period
                    GROUP BY m.listener, m.period))""",
    "o_status": """
        SELECT t.*, CASE WHEN mbid IN (SELECT recording_mbid FROM layer) THEN 'resolved' WHEN mbid IS NULL THEN 'unresolved_identity'
                         WHEN s.status IN ('complete', 'complete_empty') THEN 'resolved_without_evidence' WHEN s.status = 'failed' THEN 'terminal_failure'
                         ELSE 'pending_enrichment' END AS recording_status, s.status AS stored
        FROM o_tracks t LEFT JOIN (SELECT * FROM recording_state WHERE status <> 'unknown') s ON s.recording_mbid = t.mbid""",
    "o_targets": """
        SELECT listener, period, kind, mbid AS target_mbid, rank, row_number() OVER (PARTITION BY listener, period ORDER BY rank, kind, mbid) AS position
        FROM (SELECT listener, period, CASE WHEN stored IS NOT NULL THEN 'recording' ELSE 'track' END AS kind, mbid, min(rank) AS rank
              FROM o_status WHERE recording_status = 'pending_enrichment' AND mbid IS NOT NULL GROUP BY ALL)""",
}
