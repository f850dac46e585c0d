"""Music-shaped views over the driver tables, in SQL both engines read alike.

Suppliers stand for artists, parts for recordings, orders for releases, order lines
for credits and plays, customers for listeners, events for jobs and logs. A braced
name is a driver table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from ..sources.taxonomy import Taxonomy, load_taxonomy

SNAPSHOT = "2024-a"
NOW = "2024-01-20 12:00:00"


def _uuid(text: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr(md5({text}), {a}, {n})" for a, n in cuts)


def _laid_out(text: str) -> str:
    """What ``_uuid`` gives, with the digest named once: wherever Spark puts the expression, it is computed once."""
    laid = f"md5({text})"
    for at in (9, 14, 19, 24):
        laid = f"overlay({laid} PLACING '-' FROM {at} FOR 0)"
    return laid


_UUID = re.compile(re.escape(_uuid("@")).replace("@", "(.+?)", 1).replace("@", r"\1"))


def _id(kind: str, key: str) -> str:
    return _uuid(f"'{kind}:' || CAST({key} AS STRING)")


BRIDGE: dict[str, str] = {
    # Order lines with the relation they describe: four brands carry credits of the
    # supported kinds, the others relations the engine filters out.
    "line": """
        SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_tax,
               l_returnflag, l_linestatus, CAST(l_shipdate AS TIMESTAMP) AS l_shipdate,
               CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')
                    THEN CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2
                              WHEN p_size <= 25 THEN 3 ELSE 4 END
                    ELSE 5 END AS type_id,
               l_partkey * 32 + CAST(l_linenumber AS BIGINT) * 4
                 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS link_id
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "d_link_type": """SELECT * FROM (VALUES (1, 'Instrument'), (2, 'Vocal'), (3, 'programming'), (4, 'Samples'),
        (5, 'producer')) AS v(id, name)""",
    "d_instrument": """SELECT * FROM (VALUES
        (1, 'e0000001-0000-4000-8000-000000000001', 'electric guitar'),
        (2, 'e0000002-0000-4000-8000-000000000002', 'drums (drum set)'),
        (3, 'e0000003-0000-4000-8000-000000000003', 'synthesizer'),
        (4, 'e0000004-0000-4000-8000-000000000004', 'cello'),
        (5, 'e0000005-0000-4000-8000-000000000005', 'sampler'),
        (6, 'e0000006-0000-4000-8000-000000000006', 'violin')) AS v(id, gid, name)""",
    "d_link_attribute_type": """SELECT * FROM (VALUES
        (1, 'e0000001-0000-4000-8000-000000000001', 'electric guitar'),
        (2, 'e0000002-0000-4000-8000-000000000002', 'drums (drum set)'),
        (3, 'e0000003-0000-4000-8000-000000000003', 'synthesizer'),
        (4, 'e0000004-0000-4000-8000-000000000004', 'cello'),
        (5, 'e0000005-0000-4000-8000-000000000005', 'sampler'),
        (6, 'e0000006-0000-4000-8000-000000000006', 'violin'),
        (7, 'f0000007-0000-4000-8000-000000000007', 'solo'),
        (8, 'f0000008-0000-4000-8000-000000000008', 'guest')) AS v(id, gid, name)""",
    "d_link": "SELECT DISTINCT link_id AS id, type_id AS link_type FROM line",
    "d_link_attribute": """
        SELECT DISTINCT link_id AS link, l_linenumber AS attribute_type FROM line
        UNION ALL SELECT DISTINCT link_id AS link, CAST(8 AS BIGINT) AS attribute_type FROM line WHERE l_returnflag = 'R'
        UNION ALL SELECT DISTINCT link_id AS link, CAST(99 AS BIGINT) AS attribute_type FROM line WHERE l_linenumber = 7""",
    "d_link_attribute_credit": """
        SELECT link_id AS link, l_linenumber AS attribute_type,
               CASE WHEN l_tax < 0.02 THEN '' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS credited_as
        FROM line WHERE l_tax < 0.05""",
    "d_l_artist_recording": "SELECT link_id AS link, l_suppkey AS artist, l_partkey AS recording FROM line WHERE l_linestatus = 'F'",
    "d_l_artist_release": "SELECT link_id AS link, l_suppkey AS artist, l_orderkey AS release FROM line WHERE l_linestatus = 'O'",
    "d_artist": f"""
        SELECT s_suppkey AS id, {_id('artist', 's_suppkey')} AS gid,
               CASE WHEN s_nationkey = 0 THEN 'Various Artists' ELSE s_name END AS name FROM {{supplier}}""",
    "d_recording": f"SELECT p_partkey AS id, {_id('recording', 'p_partkey')} AS gid, p_name AS title FROM {{part}}",
    "d_release": f"""
        SELECT o_orderkey AS id, {_id('release', 'o_orderkey')} AS gid, o_orderpriority AS title
        FROM {{orders}} WHERE o_orderstatus <> 'P'""",
    "d_medium": "SELECT o_orderkey AS id, o_orderkey AS release FROM {orders}",
    "d_track": f"""
        SELECT DISTINCT {_uuid("'track:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_partkey AS STRING)")} AS gid,
               l_partkey AS recording, l_orderkey AS medium FROM {{lineitem}}""",
    # One row per listener and recording, ranked by plays.
    "play": """
        SELECT o_custkey, l_partkey, min(l_suppkey) AS l_suppkey, max(l_orderkey) AS l_orderkey,
               CAST(sum(l_quantity) AS BIGINT) AS play_count, max(CAST(o_orderdate AS TIMESTAMP)) AS last_played
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "history": f"""
        SELECT o_custkey AS listener, 'overall' AS period,
               row_number() OVER (PARTITION BY o_custkey ORDER BY play_count DESC, l_partkey) AS rank,
               p_name AS title, CASE WHEN s_nationkey = 0 THEN 'Various  Artists' ELSE s_name END AS artist, play_count,
               CASE WHEN p_size <= 2 THEN NULL ELSE {_id('recording', 'l_partkey')} END AS mbid,
               CASE WHEN s_acctbal < 0 THEN NULL ELSE {_id('artist', 'l_suppkey')} END AS artist_mbid,
               {_uuid("'track:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_partkey AS STRING)")} AS track_mbid
        FROM play JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "subject": """SELECT * FROM (VALUES
        (1, 'electric-guitar', 'Guitarra elétrica', 'plucked-strings', 'Cordas dedilhadas', 'electric', 'instrument'),
        (2, 'drums', 'Bateria', 'percussion', 'Percussão', 'acoustic', 'instrument'),
        (3, 'synthesizer', 'Sintetizador', 'synthesizers', 'Sintetizadores', 'electronic', 'instrument'),
        (4, 'cello', 'Violoncelo', 'bowed-strings', 'Cordas friccionadas', 'acoustic', 'instrument'),
        (5, 'sampler', 'Sampler', 'sampled-sounds', 'Sons sampleados', 'sampled', 'instrument'),
        (6, 'bowed-strings', 'Cordas friccionadas', 'bowed-strings', 'Cordas friccionadas', 'acoustic', 'family'),
        (7, 'voice', 'Voz', 'voice', 'Voz', CAST(NULL AS STRING), 'family'))
        AS v(line_no, slug, name, family_slug, family_name, nature, claim_level)""",
    # Layers of graded confidence: the grade follows the relation.
    "layer": f"""
        SELECT {_id('recording', 'l_partkey')} AS recording_mbid, slug, name, family_slug, family_name, nature, claim_level,
               CASE min(type_id) WHEN 1 THEN 'documented' WHEN 2 THEN 'strongly_associated' ELSE 'estimated' END AS confidence,
               CAST(CASE WHEN count(*) > 1 THEN 1.0 ELSE 0.8 END AS DOUBLE) AS prominence
        FROM line JOIN subject ON l_linenumber = line_no WHERE type_id < 5 AND l_linestatus = 'F'
        GROUP BY l_partkey, slug, name, family_slug, family_name, nature, claim_level""",
    "release_layer": f"""
        SELECT DISTINCT {_id('recording', 'l_partkey')} AS recording_mbid, family_slug
        FROM line JOIN subject ON l_linenumber = line_no WHERE type_id < 5 AND l_linestatus = 'O'""",
    "vocabulary_row": f"""
        SELECT {_id('artist', 'c.l_suppkey')} AS artist_mbid, slug AS instrument_slug, name AS instrument_name, family_slug,
               family_name, distinct_recordings, documented_recordings,
               CAST(distinct_recordings AS DOUBLE) / CAST(documented_recordings AS DOUBLE) AS prevalence,
               CAST(CASE WHEN slug = 'synthesizer' THEN 0.9 ELSE 1.0 END AS DOUBLE) AS evidence_quality, 'recording' AS source_scope
        FROM (SELECT l_suppkey, l_linenumber, count(DISTINCT l_partkey) AS distinct_recordings
              FROM line WHERE type_id = 1 AND l_linestatus = 'F' GROUP BY l_suppkey, l_linenumber) c
        JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS documented_recordings
              FROM line WHERE type_id = 1 AND l_linestatus = 'F' GROUP BY l_suppkey) d ON c.l_suppkey = d.l_suppkey
        JOIN subject ON l_linenumber = line_no WHERE claim_level = 'instrument'""",
    "recording_state": f"""
        SELECT {_id('recording', 'p_partkey')} AS recording_mbid,
               CASE p_type WHEN 'PROMO' THEN 'pending' WHEN 'ECONOMY' THEN 'failed' WHEN 'SMALL' THEN 'complete_empty'
                           WHEN 'LARGE' THEN 'unknown' ELSE 'complete' END AS status, CAST(p_size AS BIGINT) AS credit_count,
               CAST(CASE WHEN p_type = 'SMALL' THEN 0 ELSE p_size - 1 END AS BIGINT) AS mapped_credit_count
        FROM {{part}}""",
    "artist_state": f"""
        SELECT {_id('artist', 's_suppkey')} AS artist_mbid,
               CASE WHEN s_nationkey < 10 THEN 'complete' WHEN s_nationkey < 15 THEN 'complete_empty'
                    WHEN s_nationkey < 18 THEN 'failed' WHEN s_nationkey < 21 THEN 'pending' ELSE 'unknown' END AS status
        FROM {{supplier}}""",
    "snapshot": """SELECT * FROM (VALUES
        ('2023-z', 'superseded', TIMESTAMP '2023-12-01 00:00:00', TIMESTAMP '2023-12-01 00:00:00'),
        ('2024-a', 'active', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:00'),
        ('2024-b', 'staging', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-01-02 00:00:00'))
        AS v(snapshot_version, status, published_at, created_at)""",
    "event": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}""",
    # One job per event; the value spreads attempts and due times.
    "job": f"""
        SELECT event_id AS id, CASE WHEN k < 90 THEN '2024-a' ELSE '2023-z' END AS snapshot_version,
               CASE event_type WHEN 'click' THEN 'track' WHEN 'purchase' THEN 'artist' ELSE 'recording' END AS target_kind,
               {_id('target', 'event_id')} AS target_mbid,
               CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'signup' THEN 'complete' ELSE 'failed' END AS status,
               CAST(least(floor(value / 20), 6) AS BIGINT) AS attempts, CAST(NULL AS STRING) AS last_error,
               CASE WHEN value < 5 THEN CAST(NULL AS TIMESTAMP) ELSE ts + INTERVAL '30' MINUTE END AS next_attempt_at,
               ts AS created_at, ts AS updated_at
        FROM event""",
    # Requests: one per user and hour, its targets named by the property.
    "request": f"""
        SELECT CAST(user_id AS STRING) || ':' || CAST(date_trunc('hour', ts) AS STRING) AS request_id, user_id, ts,
               CASE event_type WHEN 'click' THEN 'track' WHEN 'purchase' THEN 'artist' ELSE 'recording' END AS kind,
               {_id('target', 'k')} AS target_mbid
        FROM event""",
    # Requests of an admission log: one per user and hour, over more targets, some malformed.
    "asked": f"""
        SELECT CAST(user_id AS STRING) || ':' || CAST(date_trunc('hour', ts) AS STRING) AS request_id, ts,
               CASE event_type WHEN 'click' THEN 'track' WHEN 'purchase' THEN 'artist' WHEN 'view' THEN 'recording' ELSE CASE WHEN k = 7 THEN 'album' ELSE 'recording' END END AS kind,
               CASE WHEN k = 8 AND value < 20 THEN 'no-id' ELSE {_id('target', 'event_id % 4000')} END AS target_mbid
        FROM event""",
    "asked_queue": """
        SELECT kind, target_mbid, min(ts) AS created_at FROM asked
        WHERE ts < TIMESTAMP '2024-01-01 12:00:00' AND kind <> 'album' AND target_mbid <> 'no-id' GROUP BY kind, target_mbid""",
    # Evidence as it may arrive: stray case and blanks, missing and unknown values.
    "raw_evidence": f"""
        SELECT CASE WHEN l_tax > 0.075 THEN 'no-id' ELSE chr(9) || ' ' || upper({_id('recording', 'l_partkey')}) || chr(160) END AS recording_mbid,
               {_id('artist', 'l_suppkey')} AS artist_mbid,
               CASE WHEN l_linenumber = 7 THEN '' ELSE {_id('instrument', 'l_linenumber')} END AS instrument_mbid,
               CASE WHEN l_tax > 0.065 THEN chr(160) || chr(9) ELSE chr(160) || 'part ' || CAST(l_linenumber AS STRING) END AS instrument_name,
               CASE WHEN l_quantity > 40 THEN 'solo |' || chr(9) || 'guest ||' || chr(160) || ' solo' ELSE 'solo' END AS attribute_text,
               CASE l_returnflag WHEN 'A' THEN chr(9) || 'Instrument' || chr(160) WHEN 'N' THEN '' ELSE 'Vocal' END AS relation_type,
               CASE l_linenumber WHEN 1 THEN chr(160) || 'release' || chr(9) WHEN 2 THEN '' WHEN 3 THEN 'track' ELSE 'recording' END AS scope,
               CASE WHEN l_quantity < 10 THEN chr(9) ELSE 'programmed' || chr(160) END AS production_method,
               CASE WHEN l_quantity < 5 THEN chr(160) ELSE 'Player' END AS performer, 'x' AS original_credit,
               CASE WHEN l_quantity < 3 THEN '' ELSE 'https://example.org/' || CAST(l_orderkey AS STRING) END AS source_url,
               CASE WHEN l_quantity < 20 THEN '' ELSE '2024-a' END AS snapshot_version
        FROM line""",
    # Editorial blocks: whole documents, cited to their source.
    "block": """
        SELECT CAST(d.doc_id AS STRING) AS block_id, d.lang AS subject_slug, 'curiosity' AS section_kind, d.text AS text,
               CASE WHEN l.quality IS NULL THEN 'draft' WHEN l.toxic = 1 THEN 'deprecated' WHEN l.quality = 1 THEN 'published' ELSE 'sourced' END AS status,
               coalesce(l.quality, 0) = 1 AS claim_support_verified
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "citation": """
        SELECT CAST(d.doc_id AS STRING) AS block_id, d.source AS source_id, CAST(NULL AS STRING) AS locator, CAST(NULL AS STRING) AS citation_note
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.toxic = 0""",
    "editorial_source": """
        SELECT source AS id, min(lang) AS title, source NOT IN ('src3', 'src8') AS metadata_verified,
               '["A. Writer"]' AS contributors_json
        FROM {documents} GROUP BY source""",
}

# Spark's own texts of views: the same rows, made distinct or ranked before ids are computed of them.
IDS_LAST: dict[str, str] = {
    "d_track": f"""
        SELECT {_uuid("'track:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_partkey AS STRING)")} AS gid,
               l_partkey AS recording, l_orderkey AS medium FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {{lineitem}}) AS pair""",
    "history": f"""
        SELECT listener, 'overall' AS period, rank, p_name AS title, CASE WHEN s_nationkey = 0 THEN 'Various  Artists' ELSE s_name END AS artist, play_count,
               CASE WHEN p_size <= 2 THEN NULL ELSE {_id('recording', 'l_partkey')} END AS mbid,
               CASE WHEN s_acctbal < 0 THEN NULL ELSE {_id('artist', 'l_suppkey')} END AS artist_mbid,
               {_uuid("'track:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_partkey AS STRING)")} AS track_mbid
        FROM (SELECT *, row_number() OVER (PARTITION BY listener ORDER BY play_count DESC, l_partkey) AS rank
              FROM (SELECT o_custkey AS listener, l_orderkey, l_partkey, l_suppkey, play_count, p_name, p_size, s_name, s_nationkey, s_acctbal
                    FROM play JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey) AS named) AS ranked""",
}

_WORD = re.compile(r"[a-z_0-9]+")


class Tables:
    """The driver tables of one folder and the views over them, resolved once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            text = _UUID.sub(lambda m: _laid_out(m[1]), IDS_LAST.get(name, BRIDGE[name]))
            drivers = re.findall(r"\{([a-z]+)\}", text)
            needed = [n for n in set(_WORD.findall(text)) & BRIDGE.keys() if n != name]
            # Only names in table position refer to views; the rest are literals.
            used = [n for n in needed if re.search(rf"(FROM|JOIN) {n}\b", text)]
            text = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", text) if used else text
            frames = {n: self.table(n) for n in drivers} | {n: self.view(n) for n in used}
            self._views[name] = self.spark.sql(text, **frames)
        return self._views[name]

    def over(self, name: str, frame: DataFrame) -> Tables:
        """The same tables, with a frame in place of one view for all views over it."""
        other = Tables(self.spark, self.sf_dir)
        other._tables, other._views[name] = self._tables, frame
        return other

    def built(self, name: str, make: Callable[[Tables], DataFrame]) -> DataFrame:
        """A lazy frame several queries start from; only its analyzed plan is kept."""
        if name not in self._built:
            self._built[name] = make(self)
        return self._built[name]

    def dump(self) -> dict[str, DataFrame]:
        """The views shaped like the typed dump tables."""
        return {name[2:]: self.view(name) for name in BRIDGE if name.startswith("d_")}

    @property
    def taxonomy(self) -> Taxonomy:
        return load_taxonomy(self.spark, [("e0000004-0000-4000-8000-000000000004", "cello")])


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables of a session and folder; plans over them share their resolved relations."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN or _OPEN[key].spark is not spark:
        _OPEN[key] = Tables(spark, sf_dir)
    return _OPEN[key]
