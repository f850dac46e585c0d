"""Queries over scalars, jobs, snapshots, logs and the editorial catalog."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn
from ..config import DEFAULT, RETRY_DELAYS, SERVING_SCHEMA, Policy
from ..operators import admission as ad
from ..operators import catalog as ca
from ..operators import counts as co
from ..operators import evidence as ev
from ..operators import hydration as hy
from ..operators import listening as ls
from ..operators import quality as qu
from ..operators import snapshots as sn
from ..operators import studies as st
from ..operators import tables as tb
from ..session import cut_lineage, shared_folder, stored
from ..sources import store
from ..sources.dump import union_all
from .bridge import NOW, SNAPSHOT, Tables
from .oracle import half_up
from .q_evidence import _claims_over, _relations, _served_over, _served_vocabulary, _supported
from .registry import query


def _now():
    return F.to_timestamp(F.lit(NOW))


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# ---- scalars

@query("g01_alias_form", r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', ' ', 'g'))) AS alias_digest FROM documents")
def alias_form(t: Tables) -> DataFrame:
    return fn.with_normalized_alias(t.table("documents").select("doc_id", "text"), "text", "alias").select("doc_id", F.md5("alias").alias("alias_digest"))


@query("g03_half_up", f"SELECT l_orderkey, l_linenumber, l_partkey, {half_up('l_extendedprice / 7.0::DOUBLE', 4)} AS four, {half_up('l_discount * l_tax', 2)} AS two FROM lineitem")
def half(t: Tables) -> DataFrame:
    price, product = F.col("l_extendedprice") / 7.0, F.col("l_discount") * F.col("l_tax")
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.round_half_up(price, 4).alias("four"), fn.round_half_up(product, 2).alias("two"))


@query("g04_shard_keys", """
    SELECT kind, shard, CAST(CAST('0x' || shard AS BIGINT) AS BIGINT) AS number, CAST(count(*) AS BIGINT) AS ids FROM (
      SELECT 'recording' AS kind, substr(gid, 1, 4) AS shard FROM d_recording UNION ALL SELECT 'artist', substr(gid, 1, 3) FROM d_artist) GROUP BY ALL""")
def shard_keys(t: Tables) -> DataFrame:
    def of(view: str, kind: str, shards: int) -> DataFrame:
        width = fn.shard_width(shards)
        return t.view(view).select(F.lit(kind).alias("kind"), fn.shard_key(F.col("gid"), width).alias("shard"), fn.shard_number(F.col("gid"), width).alias("number"))

    rows = of("d_recording", "recording", 65_536).unionByName(of("d_artist", "artist", 4_096))
    return rows.groupBy("kind", "shard", "number").agg(F.count(F.lit(1)).alias("ids"))


@query("g05_content_digest", """
    SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS digest FROM orders""")
def content_digest(t: Tables) -> DataFrame:
    return t.table("orders").select("o_orderkey", fn.content_digest("o_orderkey", "o_custkey", "o_orderpriority").alias("digest"))


@query("g05_document_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def document_digest(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("g06_source_urls", "SELECT gid, 'https://musicbrainz.org/recording/' || gid AS url FROM d_recording")
def source_urls(t: Tables) -> DataFrame:
    return t.view("d_recording").select("gid", fn.source_url("recording", F.col("gid")).alias("url"))


@query("g07_performer_identity", """
    SELECT performer, coalesce('mbid:' || artist_mbid, 'name:' || lower(trim(performer))) AS who, CAST(count(*) AS BIGINT) AS tracks FROM (
      SELECT artist || ' ' AS performer, artist_mbid FROM history) GROUP BY ALL""")
def performers(t: Tables) -> DataFrame:
    rows = t.view("history").select(F.concat("artist", F.lit(" ")).alias("performer"), "artist_mbid")
    return rows.groupBy("performer", fn.performer_identity(F.col("artist_mbid"), F.col("performer")).alias("who")).agg(F.count(F.lit(1)).alias("tracks"))


@query("g08_sorted_sources", """
    SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([o_orderpriority, o_orderstatus, o_orderpriority, ' '], lambda x: trim(x) <> ''))), '|') AS sources,
           least(o_orderpriority, o_orderstatus) AS first_source FROM orders""")
def sorted_sources(t: Tables) -> DataFrame:
    urls = F.array("o_orderpriority", "o_orderstatus", "o_orderpriority", F.lit(" "))
    return t.table("orders").select("o_orderkey", F.array_join(fn.sorted_sources(urls), "|").alias("sources"), fn.first_source(urls).alias("first_source"))


@query("g10_timestamps", r"""
    SELECT event_id, CASE WHEN event_type = 'click' THEN strftime(make_timestamp(CAST(floor(value) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')
                          WHEN event_type = 'view' THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') END AS registered FROM event""")
def timestamps(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    unixtime = F.when(kind == "click", F.floor("value").cast("string")).when(kind == "view", "soon")
    text = F.when(kind == "view", "last spring").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.view("event").select("event_id", fn.registered_iso(unixtime, text).alias("registered"))


@query("g11_day_month_keys", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month,
           CAST(greatest(1, ceil((86400000000 - epoch_us(ts) % 86400000000) / 1000000.0::DOUBLE)) AS BIGINT) AS seconds_left FROM event""")
def day_keys(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.view("event").select("event_id", fn.day_key(ts).alias("day"), fn.month_key(ts).alias("month"), fn.seconds_until_tomorrow(ts).alias("seconds_left"))


@query("g13_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS item FROM events")
def json_extract(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    wrapped = F.from_json(F.concat(F.lit("["), F.col("props"), F.lit("]")), "array<struct<k: bigint>>")
    return t.table("events").select("event_id", k.alias("k"), F.inline(wrapped).alias("item")).withColumn("item", F.col("item") * 2)


@query("g13_json_paths", """
    WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, o_totalprice > 150000 AS large FROM orders)
    SELECT o_orderkey, 'customer.id' AS path, 'id' AS key, CAST(0 AS INTEGER) AS position, 'number' AS kind, CAST(o_custkey AS VARCHAR) AS value FROM o
    UNION ALL SELECT o_orderkey, 'customer.tags[0]', NULL, 0, 'string', o_orderstatus FROM o
    UNION ALL SELECT o_orderkey, 'customer.tags[1]', NULL, 1, 'object', '{"text":"' || o_orderpriority || '"}' FROM o
    UNION ALL SELECT o_orderkey, 'large', 'large', 2, 'boolean', CAST(large AS VARCHAR) FROM o
    UNION ALL SELECT o_orderkey, 'deep.a.b', 'b', 0, 'object', '{"c":{"d":' || o_custkey || '}}' FROM o""")
def json_paths(t: Tables) -> DataFrame:
    tag = F.array(F.col("o_orderstatus"), F.to_json(F.struct(F.col("o_orderpriority").alias("text"))))
    tags = F.concat(F.lit('["'), tag[0], F.lit('",'), tag[1], F.lit("]"))
    body = F.concat(
        F.lit('{"customer":{"id":'), F.col("o_custkey"), F.lit(',"tags":'), tags, F.lit('},"deep":{"a":{"b":{"c":{"d":'), F.col("o_custkey"),
        F.lit('}}}},"large":'), (F.col("o_totalprice") > 150000).cast("string"), F.lit(',"none":{},"list":[]}'),
    )
    return fn.unnest_json(t.table("orders").select("o_orderkey", body.alias("payload")), "payload", depth=3).where("path not in ('none', 'list')")


@query("g14_locales", """
    SELECT lang, CASE lang WHEN 'en' THEN 'en-US' ELSE 'en-US' END AS effective, CASE lang WHEN 'en' THEN 'en-US' END AS matched, CAST(count(*) AS BIGINT) AS documents FROM documents GROUP BY 1""")
def locales(t: Tables) -> DataFrame:
    lang = F.col("lang")
    effective = ca.resolve_locale(lang, F.lit(None).cast("string"), F.array(lang))
    return t.table("documents").groupBy("lang", effective.alias("effective"), ca.locale_of(lang).alias("matched")).agg(F.count(F.lit(1)).alias("documents"))


@query("g15_retry_delays", f"SELECT id, [{', '.join(map(str, RETRY_DELAYS))}][greatest(1, least(attempts, 5))] AS delay FROM job")
def delays(t: Tables) -> DataFrame:
    return t.view("job").select("id", fn.retry_delay_seconds(F.col("attempts")).alias("delay"))


@query("g16_reading_ids", """
    SELECT page_id, 'editorial-page-' || page_id || '-reading-' || substr(sha256('page:' || page_id || ':' || md5(html) || ':' || url), 1, 16) AS reading FROM pages""")
def reading_ids(t: Tables) -> DataFrame:
    slug = F.col("page_id").cast("string")
    return t.table("pages").select("page_id", fn.reading_id(F.lit("page"), slug, F.md5("html"), F.col("url")).alias("reading"))


# ---- history and logs

@query("e08_ranked_pages", """
    SELECT listener, period, item, CAST(play_count AS BIGINT) AS play_count, CAST(rank AS BIGINT) AS rank, CAST(ceil(rank / 50.0) AS BIGINT) AS page FROM (
      SELECT *, row_number() OVER (PARTITION BY listener, period ORDER BY play_count DESC, item) AS rank FROM (
        SELECT c_mktsegment AS listener, 'overall' AS period, l_partkey AS item, sum(play_count) AS play_count FROM play JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3))
    WHERE rank <= 200""")
def ranked_pages(t: Tables) -> DataFrame:
    segments = t.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("listener"))
    plays = t.view("play").join(segments, "o_custkey").groupBy("listener", F.col("l_partkey").alias("item")).agg(F.sum("play_count").alias("play_count"))
    return ls.rank_history(plays.withColumn("period", F.lit("overall")), DEFAULT.max_tracks, tie="item").select(
        "listener", "period", "item", "play_count", F.col("rank").cast("bigint").alias("rank"), "page"
    )


_PERIOD_UNION = " UNION ALL ".join(
    f"SELECT user_id, k, '{name}' AS period FROM event {'' if days is None else f'''WHERE date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM event)) < {days}'''}"
    for name, days in ls.PERIOD_DAYS.items()
)


@query("h09_top_tracks", f"""
    SELECT listener, period, item, play_count, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY listener, period ORDER BY play_count DESC, item) AS rank FROM (
        SELECT user_id AS listener, period, k AS item, CAST(count(*) AS BIGINT) AS play_count FROM ({_PERIOD_UNION}) GROUP BY 1, 2, 3)) WHERE rank <= 200""")
def top_tracks(t: Tables) -> DataFrame:
    log = t.view("event").select(F.col("user_id").alias("listener"), F.col("k").alias("item"), "ts")
    last_day = t.view("event").agg(F.max(F.to_date("ts"))).scalar()
    plays = ls.plays_in_periods(log, last_day)
    return ls.rank_history(plays, DEFAULT.max_tracks, tie="item").select("listener", "period", "item", "play_count", F.col("rank").cast("bigint").alias("rank"))


_RANKS = ", ".join(f"list_sort(list(value))[CAST(greatest(1, ceil(count(*) * {p}::DOUBLE)) AS BIGINT)] AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99))


@query("d29_request_log", f"""
    SELECT event_type AS code, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (k < 50) AS BIGINT) AS accepted, min(k) AS retry_after_min, max(k) AS retry_after_max,
           {half_up("count(*) FILTER (k < 50) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE)", 6)} AS accepted_per_second, {_RANKS}
    FROM event GROUP BY 1""")
def request_log(t: Tables) -> DataFrame:
    log = t.view("event").select(F.col("event_type").alias("code"), "ts", F.col("value").alias("latency"), F.col("k").alias("retry_after"))
    rows = st.request_log_summary(log, F.col("retry_after") < 50)
    return rows.withColumn("accepted_per_second", fn.round_half_up(F.col("accepted_per_second"), 6))


def _take_sql(name: str, pool: str, before: str, room: str) -> str:
    order = "direct DESC, h, recording_mbid"
    return f"""{name} AS (SELECT sample_id, recording_mbid, artist_id, direct, h FROM {before} UNION ALL SELECT sample_id, recording_mbid, artist_id, direct, h FROM (
      SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY i > 1, {order}) AS r FROM (
        SELECT c.*, row_number() OVER (PARTITION BY c.sample_id, c.artist_id ORDER BY {order}) + coalesce(n.n, 0) AS i
        FROM (SELECT * FROM drawn d WHERE {pool} AND NOT EXISTS (SELECT 1 FROM {before} b WHERE b.sample_id = d.sample_id AND b.recording_mbid = d.recording_mbid)) c
        LEFT JOIN (SELECT sample_id, artist_id, count(*) AS n FROM {before} GROUP BY 1, 2) n ON n.sample_id = c.sample_id AND n.artist_id = c.artist_id)
      WHERE i <= 3) x WHERE r <= coalesce((SELECT {room} AND y.sample_id = x.sample_id), 15))"""


@query("e12_example_sample", f"""
    WITH drawn AS (SELECT c_mktsegment AS sample_id, mbid AS recording_mbid, min(artist_mbid) AS artist_id, bool_or(mbid IN (SELECT recording_mbid FROM layer)) AS direct, md5('seed:' || mbid) AS h
                   FROM history JOIN customer ON listener = c_custkey WHERE mbid IS NOT NULL AND artist_mbid IS NOT NULL GROUP BY 1, 2),
    first_pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, artist_id ORDER BY direct DESC, h, recording_mbid) AS i FROM drawn
                              WHERE artist_id IN (SELECT artist_mbid FROM vocabulary_row WHERE distinct_recordings >= 8)) WHERE i = 1),
    {_take_sql('stage_a', 'direct', 'first_pick', '15 - least(count(*), 5) FROM drawn y WHERE NOT y.direct')},
    {_take_sql('stage_b', 'NOT direct', 'stage_a', '15 - count(*) FROM stage_a y WHERE true')},
    {_take_sql('stage_c', 'true', 'stage_b', '15 - count(*) FROM stage_b y WHERE true')}
    SELECT sample_id, recording_mbid, artist_id, direct,
           CAST(CASE WHEN artist_id IN (SELECT artist_mbid FROM vocabulary_row WHERE distinct_recordings >= 8) THEN 12 ELSE CAST('0x' || substr(h, 1, 8) AS BIGINT) % 11 + 2 END * 24 AS BIGINT) AS play_count
    FROM stage_c""")
def sample(t: Tables) -> DataFrame:
    segments = t.table("customer").select(F.col("c_custkey").alias("listener"), F.col("c_mktsegment").alias("sample_id"))
    played = t.view("history").where("mbid is not null and artist_mbid is not null").select(
        "listener", fn.packed_id(F.col("mbid")).alias("recording_mbid"), fn.packed_id(F.col("artist_mbid")).alias("artist_id")
    ).join(segments, "listener")
    direct = t.view("layer").select("recording_mbid").distinct().withColumn("d", F.lit(True))
    # Of a recording's artists the sample takes the least; so only its one row of a sample goes on.
    rows = played.withColumn("artist_id", fn.unpacked_id(F.col("artist_id"))).groupBy("sample_id", "recording_mbid").agg(F.min("artist_id").alias("artist_id"))
    rows = rows.withColumn("recording_mbid", fn.unpacked_id(F.col("recording_mbid"))).join(direct, "recording_mbid", "left").withColumn("direct", F.coalesce("d", F.lit(False))).drop("d")
    priority = t.view("vocabulary_row").where("distinct_recordings >= 8").select(F.col("artist_mbid").alias("artist_id"))
    return st.example_sample(stored(rows, "drawn"), priority, "seed")


# ---- jobs

def _active(t: Tables) -> DataFrame:
    return sn.active_snapshot(t.view("snapshot"))


_ELIGIBLE = f"""
    SELECT * FROM job WHERE snapshot_version = '2024-a' AND (
      (status IN ('pending', 'failed') AND attempts < 5 AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}'))
      OR (status = 'processing' AND attempts <= 5 AND updated_at <= TIMESTAMP '{NOW}' - INTERVAL '10' MINUTE))"""


@query("h02_eligible_jobs", f"SELECT id, target_kind, target_mbid, status, attempts FROM ({_ELIGIBLE})")
def eligible(t: Tables) -> DataFrame:
    return hy.eligible_jobs(t.view("job"), _active(t), _now()).select("id", "target_kind", "target_mbid", "status", "attempts")


@query("h02_claimed_jobs", f"""
    SELECT id, 'processing' AS status, CASE WHEN status = 'processing' AND attempts = 5 THEN attempts ELSE attempts + 1 END AS attempts, '{NOW}' AS updated_at FROM ({_ELIGIBLE})""")
def claimed(t: Tables) -> DataFrame:
    rows = hy.claim_jobs(hy.eligible_jobs(t.view("job"), _active(t), _now()), _now())
    return rows.select("id", "status", "attempts", _stamp("updated_at"))


@query("e07_oldest_jobs", f"""
    SELECT id, target_kind, CAST(position AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_version ORDER BY created_at, id) AS position FROM ({_ELIGIBLE})) WHERE position <= 500""")
def oldest(t: Tables) -> DataFrame:
    rows = hy.oldest_jobs(hy.eligible_jobs(t.view("job"), _active(t), _now()), 500)
    return rows.select("id", "target_kind", F.col("position").cast("bigint").alias("position"))


@query("h04_failed_jobs", f"""
    SELECT id, 'failed' AS status, CASE WHEN e THEN 5 ELSE attempts END AS attempts, e AS terminal,
           strftime(CASE WHEN NOT e THEN TIMESTAMP '{NOW}' + to_seconds([{', '.join(map(str, RETRY_DELAYS))}][greatest(1, least(attempts, 5))]) END, '%Y-%m-%d %H:%M:%S') AS next_attempt_at
    FROM (SELECT *, k_hard OR attempts >= 5 AS e FROM (SELECT *, target_kind = 'artist' AS k_hard FROM job))""")
def failed(t: Tables) -> DataFrame:
    rows = hy.fail_jobs(t.view("job"), _now(), F.lit("error"), F.col("target_kind") == "artist")
    return rows.select("id", "status", F.col("attempts").cast("bigint").alias("attempts"), "terminal", _stamp("next_attempt_at"))


@query("h04_deferred_jobs", f"SELECT id, 'pending' AS status, greatest(attempts - 1, 0) AS attempts, strftime(TIMESTAMP '{NOW}' + INTERVAL '2' MINUTE, '%Y-%m-%d %H:%M:%S') AS next_attempt_at FROM job")
def deferred(t: Tables) -> DataFrame:
    return hy.defer_jobs(t.view("job"), _now(), "budget").select("id", "status", "attempts", _stamp("next_attempt_at"))


@query("f02_all_statuses", """
    SELECT recording_mbid, status FROM (SELECT recording_mbid, status FROM recording_state WHERE status <> 'unknown'
      UNION ALL SELECT target_mbid, 'failed' FROM job WHERE target_kind = 'track' AND status = 'failed' AND attempts >= 5
      UNION ALL SELECT target_mbid, 'failed' FROM job WHERE target_kind = 'track' AND status = 'pending' AND attempts >= 5)""")
def all_statuses(t: Tables) -> DataFrame:
    jobs = t.view("job").withColumn("status", F.when(F.col("status") == "pending", "failed").otherwise(F.col("status")))
    return ls.all_recording_statuses(ls.known_statuses(t.view("recording_state")), jobs)


_QUEUED = "SELECT DISTINCT kind, target_mbid FROM request WHERE ts < TIMESTAMP '2024-01-01 12:00:00'"


def _queued(t: Tables) -> DataFrame:
    """Targets asked for before the first noon are queued already."""
    return t.view("request").where("ts < timestamp '2024-01-01 12:00:00'").select("kind", "target_mbid").distinct()


@query("f06_fresh_targets", f"SELECT kind, target_mbid FROM request EXCEPT {_QUEUED}")
def fresh(t: Tables) -> DataFrame:
    return tb.fresh(t.view("request").select("kind", "target_mbid"), _queued(t), ["kind", "target_mbid"])


@query("f07_distinct_targets", "SELECT DISTINCT user_id || ':' || strftime(ts, '%Y-%m-%d') AS request_id, kind, target_mbid FROM request")
def distinct_targets(t: Tables) -> DataFrame:
    named = t.view("request").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), fn.day_key(F.col("ts"))).alias("request_id"), "kind", "target_mbid")
    return named.dropDuplicates(["request_id", "kind", "target_mbid"])


@query("h01_request_units", f"""
    WITH q AS ({_QUEUED}),
    firsts AS (SELECT kind, target_mbid, arg_min(request_id, (ts, request_id)) AS request_id FROM request r WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.kind = r.kind AND q.target_mbid = r.target_mbid) GROUP BY 1, 2)
    SELECT a.request_id, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(coalesce(f.u, 0) AS BIGINT) AS fresh_units,
           CAST((SELECT sum(CASE WHEN kind = 'track' THEN 2 ELSE 1 END) FROM q) AS BIGINT) AS backlog_units,
           CAST(coalesce((SELECT sum(CASE WHEN kind = 'track' THEN 2 ELSE 1 END) FROM (SELECT kind, target_mbid, min(ts) AS made FROM request WHERE ts < TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1, 2) x
                          WHERE CAST(x.made AS DATE) = CAST(a.ts AS DATE)), 0) AS BIGINT) AS used_units
    FROM (SELECT request_id, min(ts) AS ts FROM request GROUP BY 1) a
    LEFT JOIN (SELECT request_id, sum(CASE WHEN kind = 'track' THEN 2 ELSE 1 END) AS u FROM firsts GROUP BY 1) f USING (request_id)""")
def units(t: Tables) -> DataFrame:
    made = t.view("request").where("ts < TIMESTAMP '2024-01-01 12:00:00'").groupBy("kind", "target_mbid").agg(F.min("ts").alias("created_at"))
    jobs = made.select(F.col("kind").alias("target_kind"), "target_mbid", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "created_at")
    rows = hy.request_units(t.view("request"), jobs)
    return rows.select("request_id", _stamp("ts"), *(F.col(c).cast("bigint").alias(c) for c in ("fresh_units", "backlog_units", "used_units")))


_ADMISSION = Policy(max_pending_units=5_000, daily_new_units=360)


@query("h01_admission", f"""
    WITH checked AS (SELECT *, kind <> 'album' AND target_mbid <> 'no-id' AS ok FROM asked),
    requests AS (
      SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY ok, CAST(ts AS DATE) ORDER BY ts, request_id) AS call
      FROM (SELECT request_id, min(ts) AS ts, bool_and(ok) AS ok, count(DISTINCT kind || target_mbid) AS targets FROM checked GROUP BY request_id)),
    numbers AS (SELECT kind, target_mbid, row_number() OVER (ORDER BY kind, target_mbid) - 1 AS no FROM (SELECT DISTINCT kind, target_mbid FROM checked WHERE ok)),
    bits AS (
      SELECT request_id, coalesce(bitstring_agg(no, 0, 11999) FILTER (kind = 'track'), bitstring('0', 12000)) AS tracks,
             coalesce(bitstring_agg(no, 0, 11999) FILTER (kind <> 'track'), bitstring('0', 12000)) AS others
      FROM checked JOIN numbers USING (kind, target_mbid) WHERE ok GROUP BY request_id),
    waiting AS (SELECT coalesce(sum(CASE WHEN kind = 'track' THEN 2 ELSE 1 END), 0) AS units, coalesce(bitstring_agg(no, 0, 11999), bitstring('0', 12000)) AS seen FROM asked_queue JOIN numbers USING (kind, target_mbid)),
    spent AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, sum(CASE WHEN kind = 'track' THEN 2 ELSE 1 END) AS units FROM asked_queue GROUP BY 1),
    called AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY ts, request_id) AS i, request_id, day, tracks, others, coalesce(s.units, 0) AS spent
      FROM requests JOIN bits USING (request_id) LEFT JOIN spent s USING (day) WHERE ok AND call <= {_ADMISSION.daily_calls}),
    decided AS (
      WITH RECURSIVE step AS (
        SELECT CAST(0 AS BIGINT) AS i, '' AS request_id, '' AS day, seen, CAST(0 AS BIGINT) AS today, CAST(units AS BIGINT) AS total,
               CAST(0 AS BIGINT) AS fresh, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS backlog, false AS admitted FROM waiting
        UNION ALL
        SELECT i, request_id, day, CASE WHEN admitted THEN seen | tracks | others ELSE seen END, CASE WHEN admitted THEN used + fresh ELSE used END,
               CASE WHEN admitted THEN backlog + fresh ELSE backlog END, fresh, used, backlog, admitted
        FROM (SELECT *, fresh = 0 OR used + fresh <= {_ADMISSION.daily_new_units} AND backlog + fresh <= {_ADMISSION.max_pending_units} AS admitted
              FROM (SELECT c.i, c.request_id, c.day, p.seen, c.tracks, c.others, CAST(2 * bit_count(c.tracks & ~p.seen) + bit_count(c.others & ~p.seen) AS BIGINT) AS fresh,
                           CAST(CASE WHEN c.day = p.day THEN p.today ELSE c.spent END AS BIGINT) AS used, p.total AS backlog
                    FROM step p JOIN called c ON c.i = p.i + 1)))
      SELECT request_id, fresh, used, backlog, admitted FROM step WHERE i > 0)
    SELECT request_id, day, coalesce(admitted, false) AS admitted,
           CASE WHEN NOT ok THEN 'invalid_request' WHEN admitted THEN NULL WHEN admitted IS NULL OR used + fresh > {_ADMISSION.daily_new_units} THEN 'hydration_daily_budget' ELSE 'hydration_busy' END AS code,
           CAST(CASE WHEN NOT ok OR admitted THEN NULL
                     WHEN admitted IS NULL OR used + fresh > {_ADMISSION.daily_new_units} THEN greatest(1, 86400 - (epoch_us(ts) % 86400000000) // 1000000) ELSE 120 END AS BIGINT) AS retry_after,
           CAST(CASE WHEN admitted THEN targets ELSE 0 END AS BIGINT) AS accepted, fresh AS fresh_units, backlog AS backlog_units, used AS used_units
    FROM requests LEFT JOIN decided USING (request_id)""")
def admission(t: Tables) -> DataFrame:
    queue = t.view("asked_queue").select(
        F.lit(SNAPSHOT).alias("snapshot_version"), F.col("kind").alias("target_kind"), "target_mbid", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "created_at"
    )
    return ad.decide(t.view("asked"), queue, _ADMISSION, strict=False).drop("ts")


@query("h03_materialized", """
    SELECT 'recording' AS kind, recording_mbid AS id, status, credit_count AS total, mapped_credit_count AS mapped FROM (
      SELECT r.gid AS recording_mbid, coalesce(CASE WHEN m > 0 THEN 'complete' END, 'complete_empty') AS status, CAST(coalesce(c, 0) AS BIGINT) AS credit_count, CAST(coalesce(m, 0) AS BIGINT) AS mapped_credit_count
      FROM d_recording r LEFT JOIN (SELECT recording_mbid, sum(credit_count) AS c, coalesce(sum(credit_count) FILTER (s.subject_slug IS NOT NULL), 0) AS m
                                    FROM o_claims LEFT JOIN o_subject s USING (instrument_name) GROUP BY 1) x ON x.recording_mbid = r.gid)
    UNION ALL SELECT 'artist', a.gid, CASE WHEN coalesce(m, 0) > 0 THEN 'complete' ELSE 'complete_empty' END, CAST(coalesce(n, 0) AS BIGINT), CAST(coalesce(m, 0) AS BIGINT)
    FROM d_artist a LEFT JOIN (SELECT artist_mbid, count(*) AS n, count(*) FILTER (claim_level = 'instrument') AS m FROM o_vocabulary LEFT JOIN o_subject USING (instrument_name)
                               WHERE artist_name <> 'Various Artists' GROUP BY 1) y ON y.artist_mbid = a.gid""")
def materialized(t: Tables) -> DataFrame:
    def targets(view: str, kind: str) -> DataFrame:
        return t.view(view).select(F.lit(SNAPSHOT).alias("snapshot_version"), F.lit(kind).alias("target_kind"), F.col("gid").alias("target_mbid"))

    jobs = targets("d_recording", "recording").unionByName(targets("d_artist", "artist"))
    # Relations serve claims and vocabulary, direct rows all three counts of the vocabulary: each is written once.
    supported = _supported(t)
    supported.built("relations", lambda s: stored(ev.link_relations(s.dump()), "relations"))
    supported.built("direct", lambda s: stored(ev.direct_evidence(s.dump(), _relations(s), SNAPSHOT), "direct"))
    new = hy.materialize(jobs, hy.Servings(_served_over(supported), _claims_over(supported), _served_vocabulary(supported)), t.taxonomy, _now())
    recordings = new.recordings.select(F.lit("recording").alias("kind"), F.col("recording_mbid").alias("id"), "status", F.col("credit_count").alias("total"), F.col("mapped_credit_count").alias("mapped"))
    artists = new.artists.select(F.lit("artist").alias("kind"), F.col("artist_mbid").alias("id"), "status", F.col("entry_count").alias("total"), F.col("mapped_entry_count").alias("mapped"))
    return recordings.unionByName(artists)


@query("h05_upsert", """
    SELECT recording_mbid, coalesce(n.status, o.status) AS status, o.credit_count AS first_count FROM recording_state o
    LEFT JOIN (SELECT recording_mbid, 'complete' AS status FROM recording_state WHERE status = 'pending') n USING (recording_mbid)""")
def upserted(t: Tables) -> DataFrame:
    old = t.view("recording_state").select("recording_mbid", "status", F.col("credit_count").alias("first_count"))
    new = old.where("status = 'pending'").select("recording_mbid", F.lit("complete").alias("status"), (F.col("first_count") + 1).alias("first_count"))
    once = tb.upsert(old, new, ["recording_mbid"], keep=("first_count",))
    return tb.upsert(once, new, ["recording_mbid"], keep=("first_count",))


@query("h05_sharded_upsert", """
    SELECT substr(recording_mbid, 1, 2) AS shard, recording_mbid, coalesce(n.status, o.status) AS status, o.credit_count AS first_count FROM recording_state o
    LEFT JOIN (SELECT recording_mbid, 'complete' AS status FROM recording_state WHERE status = 'pending') n USING (recording_mbid)""")
def sharded_upsert(t: Tables) -> DataFrame:
    """The same upsert into a table of 256 shard folders, twice; only folders with changes are rewritten."""
    shard = fn.shard_key(F.col("recording_mbid"), 2).alias("shard")
    old = t.view("recording_state").select("recording_mbid", "status", F.col("credit_count").alias("first_count"), shard)
    new = old.where("status = 'pending'").select("recording_mbid", F.lit("complete").alias("status"), (F.col("first_count") + 1).alias("first_count"), "shard")
    folder = shared_folder(t.spark, "recording-state")
    store.write_sharded(old, folder, "shard")
    for _ in range(2):
        store.upsert_sharded(t.spark, folder, new, ["recording_mbid"], "shard", old.schema, keep=("first_count",))
    return store.read_sharded(t.spark, folder, "shard", schema=old.schema).select("shard", "recording_mbid", "status", "first_count")


@query("c12_clustered_lookup", """
    SELECT recording_mbid, slug, confidence, prominence FROM layer WHERE recording_mbid IN (SELECT recording_mbid FROM recording_state WHERE status = 'pending')""")
def clustered_lookup(t: Tables) -> DataFrame:
    """Evidence of pending recordings, from a table in the order of its ids."""
    folder = shared_folder(t.spark, "layers")
    store.write_clustered(t.view("layer").select("recording_mbid", "slug", "confidence", "prominence"), folder, "recording_mbid")
    return store.lookup(t.spark.read.parquet(folder), t.view("recording_state").where("status = 'pending'"), "recording_mbid")


@query("h06_daily_budget", f"SELECT strftime(ts, '%Y-%m-%d') AS period, CAST(sum(k) AS BIGINT) AS units, sum(k) <= 16000 AS within_limit FROM event GROUP BY 1")
def budget(t: Tables) -> DataFrame:
    return hy.budget_summary(t.view("event").withColumn("units", F.col("k")), fn.day_key(F.col("ts")), 16_000)


@query("h06_budget_ledger", """
    SELECT event_id, period, CAST(charged AS BIGINT) AS charged, charged <= 100000 AS admitted FROM (
      SELECT event_id, strftime(ts, '%Y-%m') AS period, sum(k) OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS charged FROM event)""")
def ledger(t: Tables) -> DataFrame:
    usage = t.view("event").select("event_id", "ts", F.col("k").alias("units"))
    return hy.budget_ledger(usage, fn.month_key(F.col("ts")), 100_000).select("event_id", "period", "charged", "admitted")


# ---- snapshots

@query("e06_active_snapshot", "SELECT id, j.snapshot_version FROM job j WHERE j.snapshot_version = (SELECT snapshot_version FROM snapshot WHERE status = 'active' ORDER BY published_at DESC, created_at DESC LIMIT 1)")
def active(t: Tables) -> DataFrame:
    return t.view("job").join(_active(t).select("snapshot_version"), "snapshot_version", "left_semi").select("id", "snapshot_version")


@query("h07_publication", """
    SELECT snapshot_version, CASE WHEN status = 'active' AND snapshot_version <> '2024-c' THEN 'superseded' ELSE status END AS status, CAST(record_count AS BIGINT) AS record_count FROM (
      SELECT snapshot_version, status, NULL AS record_count FROM snapshot
      UNION ALL SELECT '2024-c', 'active', (SELECT count(*) FROM recording_state WHERE status = 'complete'))""")
def publication(t: Tables) -> DataFrame:
    old = t.view("snapshot").select("snapshot_version", "status", F.lit(None).cast("bigint").alias("record_count"), "published_at", "created_at")
    counts = t.view("recording_state").where("status = 'complete'").agg(F.count(F.lit(1)).alias("recording_count"), F.sum("credit_count").alias("credit_count"))
    fixed = {"snapshot_version": "2024-c", "schema_version": SERVING_SCHEMA, "source_url": "https://example.org", "license": "CC0", "attribution": "example",
             "generated_at": "unix:0", "object_prefix": "prefix", "manifest_hash": "0" * 64}
    manifest = counts.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
    return sn.publish(old, manifest, datetime(2024, 2, 1)).select("snapshot_version", "status", "record_count")


@query("h08_snapshot_pinning", "SELECT user_id, min(v) AS first_version, max(v) AS last_version FROM (SELECT user_id, CASE WHEN value > 300 THEN '2024-b' ELSE '2024-a' END AS v FROM event) GROUP BY 1 HAVING min(v) <> max(v)")
def pinning(t: Tables) -> DataFrame:
    batches = t.view("event").select("user_id", F.when(F.col("value") > 300, "2024-b").otherwise("2024-a").alias("snapshot_version"))
    return sn.mixed_snapshots(batches, ["user_id"])


@query("d26_recordings_with_evidence", "SELECT CAST(count(DISTINCT recording_mbid) AS BIGINT) AS recordings_with_evidence FROM recording_state WHERE status = 'complete' AND mapped_credit_count > 0")
def with_evidence(t: Tables) -> DataFrame:
    rows = t.view("recording_state").withColumn("snapshot_version", F.lit(SNAPSHOT))
    return ca.recordings_with_evidence(rows, _active(t))


@query("d26_mergeable_statistic", """
    SELECT 'F' AS snapshot, CAST(count(DISTINCT l_partkey) AS BIGINT) AS recordings FROM line WHERE type_id < 5 AND l_linestatus = 'F'
    UNION ALL SELECT 'O', CAST(count(DISTINCT l_partkey) AS BIGINT) FROM line WHERE type_id < 5 AND l_linestatus = 'O'
    UNION ALL SELECT 'both', CAST(count(*) AS BIGINT) FROM (SELECT l_partkey FROM line WHERE type_id < 5 AND l_linestatus = 'F' INTERSECT SELECT l_partkey FROM line WHERE type_id < 5 AND l_linestatus = 'O')
    UNION ALL SELECT 'any', CAST(count(DISTINCT l_partkey) AS BIGINT) FROM line WHERE type_id < 5""")
def mergeable_statistic(t: Tables) -> DataFrame:
    """Recordings with credits in two snapshots, in both and in either, from one bitmap a snapshot."""
    rows = t.view("line").where("type_id < 5").select(F.col("l_linestatus").alias("snapshot"), "l_partkey")
    bits = cut_lineage(co.distinct_bitmaps(rows, ["snapshot"], F.col("l_partkey")))
    first, second = (bits.where(F.col("snapshot") == s).drop("snapshot") for s in ("F", "O"))
    named = [co.distinct_counts(x, [], "recordings").select(F.lit(n).alias("snapshot"), "recordings") for n, x in (("both", co.common(first, second)), ("any", co.unite(first, second)))]
    return union_all([co.distinct_counts(bits, ["snapshot"], "recordings"), *named])


# ---- editorial

@query("b14_eligible_blocks", "SELECT block_id, subject_slug, status, md5(text) AS digest FROM block WHERE length(trim(text)) > 0 AND status IN ('sourced', 'published') AND claim_support_verified")
def eligible_blocks(t: Tables) -> DataFrame:
    return ca.eligible_blocks(t.view("block")).select("block_id", "subject_slug", "status", F.md5("text").alias("digest"))


@query("c19_editorial_sections", """
    SELECT b.block_id, b.subject_slug, CAST(1 AS BIGINT) AS citations, c.source_id FROM block b JOIN citation c ON c.block_id = b.block_id JOIN editorial_source s ON s.id = c.source_id
    WHERE length(trim(b.text)) > 0 AND b.status IN ('sourced', 'published') AND b.claim_support_verified AND s.metadata_verified""")
def editorial(t: Tables) -> DataFrame:
    rows = ca.editorial_sections(t.view("block"), t.view("citation"), t.view("editorial_source"))
    return rows.select("block_id", "subject_slug", F.size("citations").cast("bigint").alias("citations"), F.get("citations", 0)["source_id"].alias("source_id"))


@query("c19_cited_sources", """
    SELECT DISTINCT b.subject_slug, s.id, s.title, 'A. Writer' AS contributors FROM block b JOIN citation c ON c.block_id = b.block_id JOIN editorial_source s ON s.id = c.source_id
    WHERE length(trim(b.text)) > 0 AND b.status IN ('sourced', 'published') AND b.claim_support_verified AND s.metadata_verified""")
def cited(t: Tables) -> DataFrame:
    sections = ca.editorial_sections(t.view("block"), t.view("citation"), t.view("editorial_source"))
    return ca.cited_sources(sections, t.view("editorial_source")).select("subject_slug", "id", "title", F.array_join("contributors", ",").alias("contributors"))


@query("c17_asset_resolution", """
    WITH e AS (SELECT asset_id, url FROM (SELECT p_partkey AS asset_id, CASE WHEN p_size > 40 THEN 'a/<hash>.png' ELSE 'a/' || p_partkey || '.png' END AS url, p_type FROM part)
               WHERE url NOT LIKE '%<hash>%' AND p_type IN ('PROMO', 'SMALL', 'LARGE', 'ECONOMY'))
    SELECT s.p_partkey AS slug, coalesce(x.asset_id, r.asset_id, f.asset_id) AS asset_id, coalesce(x.url, r.url, f.url) AS asset_url,
           CASE WHEN x.asset_id IS NOT NULL THEN 'exact' WHEN r.asset_id IS NOT NULL THEN 'related' WHEN f.asset_id IS NOT NULL THEN 'family' END AS resolution
    FROM part s LEFT JOIN e x ON x.asset_id = s.p_partkey LEFT JOIN e r ON r.asset_id = s.p_partkey + 1
    LEFT JOIN (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1) b ON b.p_brand = s.p_brand LEFT JOIN e f ON f.asset_id = b.k""")
def assets(t: Tables) -> DataFrame:
    part = t.table("part")
    key = F.col("p_partkey")
    url = F.when(F.col("p_size") > 40, "a/<hash>.png").otherwise(F.concat(F.lit("a/"), key, F.lit(".png")))
    images = part.select(
        key.alias("asset_id"), F.when(F.col("p_type").isin("PROMO", "SMALL"), "approved").when(F.col("p_type").isin("LARGE", "ECONOMY"), "published").otherwise("draft").alias("status"),
        F.array(F.struct(F.lit("detail").alias("name"), url.alias("url"))).alias("variants"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("output"),
    )
    subjects = part.select(key.alias("slug"), F.col("p_brand").alias("family_slug"))
    exact = part.select(key.alias("slug"), key.alias("asset_id"))
    related = part.select((key - 1).alias("slug"), key.alias("asset_id"))
    family = part.groupBy(F.col("p_brand").alias("family_slug")).agg(F.min("p_partkey").alias("asset_id"))
    return ca.resolve_assets(subjects, exact, related, family, images).select("slug", "asset_id", "asset_url", "resolution")


@query("c20_slug_resolution", """
    SELECT doc_id, slug, CASE slug WHEN 'bateria' THEN 'drums' WHEN 'percussao' THEN 'percussion' ELSE slug END AS canonical_slug,
           CASE slug WHEN 'bateria' THEN 'instrument' WHEN 'piano' THEN 'instrument' WHEN 'percussao' THEN 'family' END AS kind,
           CASE slug WHEN 'bateria' THEN 'percussion' WHEN 'piano' THEN 'acoustic-keys' END AS family_slug
    FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'bateria' WHEN 'fr' THEN 'piano' WHEN 'de' THEN 'percussao' ELSE 'kazoo' END AS slug FROM documents)""")
def slug_resolution(t: Tables) -> DataFrame:
    lang = F.col("lang")
    slug = F.when(lang == "en", "bateria").when(lang == "fr", "piano").when(lang == "de", "percussao").otherwise("kazoo")
    return ca.resolve_slugs(t.table("documents").select("doc_id", slug.alias("slug")), t.taxonomy)


def _pair():
    return F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2).cast("string"))


def _translations(t: Tables) -> DataFrame:
    """A text per conversation turn: of each pair of turns the first is the source, the second its translation."""
    turns = t.table("conversations")
    good = F.length("text") > 40
    return turns.select(
        F.lit("instrument").alias("resource_type"), _pair().alias("resource_slug"), F.when(F.col("turn") % 2 == 0, "pt-BR").otherwise("en-US").alias("locale"),
        F.when(F.length("text") > 400, "r2").otherwise("r1").alias("source_revision"), F.md5("text").alias("content_revision"), F.lit("rev").alias("publication_revision"),
        F.when(good, "published").otherwise("draft").alias("status"), F.lit("someone").alias("reviewer"), F.lit("2024-01-01").alias("reviewed_at"), F.lit(None).cast("string").alias("asset_id"),
    )


@query("c21_translation_selection", """
    WITH x AS (SELECT conv_id || '-' || turn // 2 AS slug, turn % 2 AS side, md5(text) AS content, CASE WHEN length(text) > 400 THEN 'r2' ELSE 'r1' END AS rev, length(text) > 40 AS ok FROM conversations)
    SELECT c.slug AS resource_slug, NOT coalesce(s.ok, false) AS withheld,
           CASE WHEN NOT coalesce(s.ok, false) THEN NULL WHEN coalesce(w.ok AND w.rev = s.rev, false) THEN 'en-US' ELSE 'pt-BR' END AS locale,
           CASE WHEN NOT coalesce(s.ok, false) THEN NULL WHEN coalesce(w.ok AND w.rev = s.rev, false) THEN w.content ELSE s.content END AS content_revision
    FROM (SELECT DISTINCT slug FROM x) c LEFT JOIN x s ON s.slug = c.slug AND s.side = 0 LEFT JOIN x w ON w.slug = c.slug AND w.side = 1""")
def translations(t: Tables) -> DataFrame:
    requests = t.table("conversations").select(
        F.lit("instrument").alias("resource_type"), _pair().alias("resource_slug"), F.lit("en-US").alias("requested_locale"), F.lit(None).cast("string").alias("asset_id")
    ).distinct()
    published = t.spark.createDataFrame([("rev", "active", 2)], "revision string, status string, content_schema_version int")
    return ca.select_translations(requests, published, _translations(t)).select("resource_slug", "withheld", "locale", "content_revision")


def _review(ok) -> F.Column:
    return F.struct(ok.alias("claim_support_verified"), F.lit("someone").alias("reviewer"), F.lit("2024-01-01").alias("reviewed_at"))


@query("d27_translation_coverage", """
    WITH x AS (SELECT conv_id || '-' || turn // 2 AS slug, turn % 2 AS side, CASE WHEN length(text) > 400 THEN 'r2' ELSE 'r1' END AS rev FROM conversations WHERE length(text) > 40)
    SELECT locale, CAST(translated AS BIGINT) AS translated, CAST((SELECT count(*) FROM x WHERE side = 0) AS BIGINT) AS total FROM (
      SELECT 'pt-BR' AS locale, (SELECT count(*) FROM x WHERE side = 0) AS translated
      UNION ALL SELECT 'en-US', (SELECT count(*) FROM x s JOIN x w ON s.slug = w.slug AND s.side = 0 AND w.side = 1 AND s.rev = w.rev))""")
def coverage(t: Tables) -> DataFrame:
    sheets = _translations(t).select(F.col("resource_slug").alias("slug"), "locale", "status", "source_revision", _review(F.lit(True)).alias("review"))
    locales = t.spark.createDataFrame([("pt-BR",), ("en-US",)], "locale string")
    return ca.translation_coverage(sheets, locales)


@query("e11_latest_version", "SELECT CAST(event_id AS STRING) AS version FROM event ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest(t: Tables) -> DataFrame:
    return ca.latest_version(t.view("event").select(F.col("event_id").cast("string").alias("version"), F.col("ts").alias("published_at"), F.col("event_id").alias("id")))


@query("c22_dangling_and_duplicates", """
    SELECT 'dangling' AS fault, CAST(count(*) AS BIGINT) AS rows_seen FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'duplicate', CAST(count(*) AS BIGINT) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def dangling(t: Tables) -> DataFrame:
    loose = tb.dangling(t.table("documents").select("doc_id"), t.table("labels"), "doc_id", "doc_id").agg(F.count(F.lit(1)).alias("rows_seen"))
    twice = tb.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("rows_seen"))
    return loose.select(F.lit("dangling").alias("fault"), "rows_seen").unionByName(twice.select(F.lit("duplicate").alias("fault"), "rows_seen"))


@query("i02_conflicting_duplicates", "SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def conflicts(t: Tables) -> DataFrame:
    return qu.conflicting(t.table("lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", "l_linestatus"), "id").select("id")


def _sheets(t: Tables) -> DataFrame:
    """One source sheet per document: its text is a block cited to its source."""
    d = t.table("documents").join(t.table("labels"), "doc_id", "left")
    ident = F.col("doc_id").cast("string")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    source = F.struct(
        F.col("source").alias("id"), F.col("source").alias("title"), F.array(F.lit("A. Writer")).alias("contributors"), F.lit(None).cast("string").alias("publisher"),
        F.when(F.col("source") == "src5", "ftp://example.org").otherwise("https://example.org").alias("url"), F.lit("2024-01-01").alias("accessed_at"),
        F.when(F.col("source") == "src7", "blog").otherwise("book").alias("source_type"), (F.col("source") != "src3").alias("metadata_verified"), F.lit("2024-01-01").alias("verified_at"),
    )
    cite = F.struct(F.col("source").alias("source_id"), F.lit(None).cast("string").alias("locator"), F.lit(None).cast("string").alias("note"))
    block = F.struct(
        F.concat(F.lit("b"), ident).alias("id"), F.lit("curiosity").alias("kind"), F.col("text"), F.lit("editorial_summary").alias("content_type"),
        F.when(F.col("quality").isNull(), "draft").when(good, "published").otherwise("sourced").alias("status"), F.array(cite).alias("citations"), _review(good).alias("review"),
    )
    reading = F.struct(
        F.lit("More").alias("title"), F.lit("https://example.org/more").alias("url"), F.lit(None).cast("string").alias("publisher"),
        F.when(good, "reviewed").otherwise("draft").alias("status"), F.lit("someone").alias("reviewer"), F.lit("2024-01-01").alias("reviewed_at"),
    )
    return d.select(
        F.lit("instrument").alias("kind"), F.concat(F.lit("doc-"), ident).alias("slug"), F.when(F.col("lang") != "es", F.col("lang")).alias("family_slug"), F.col("source").alias("name"),
        F.lit("A text.").alias("description"), F.lit("It sounds.").alias("sound_production"), F.array(F.col("lang")).alias("common_roles"), F.array(block).alias("sections"),
        F.array(source).alias("sources"), F.array(reading).alias("further_reading"),
        F.struct(F.lit("a").alias("asset_id"), F.lit("alt").alias("alt"), F.lit("caption").alias("caption")).alias("image"),
        F.struct(F.array(F.col("source")).alias("description"), F.array().cast("array<string>").alias("sound_production")).alias("text_citations"), _review(F.lit(True)).alias("review"),
        F.lit("pt-BR").alias("locale"), F.lit("published").alias("status"), F.lit(None).cast("string").alias("source_revision"),
    )


@query("i01_sheet_violations", """
    SELECT 'doc-' || d.doc_id AS slug, v AS violation FROM (
      SELECT doc_id, 'family_slug' AS v FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 'source_url' FROM documents WHERE source = 'src5'
      UNION ALL SELECT doc_id, 'source_type' FROM documents WHERE source = 'src7'
      UNION ALL SELECT d.doc_id, 'source_unverified' FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE source = 'src3' AND quality = 1
      UNION ALL SELECT doc_id, 'block_fields' FROM documents WHERE trim(text) = '') d""")
def violations(t: Tables) -> DataFrame:
    return qu.sheet_violations(_sheets(t)).select("slug", "violation")


@query("i03_stale_translations", """
    SELECT 'doc-' || doc_id AS slug, CASE WHEN lang = 'en' THEN 'published' WHEN lang = 'fr' THEN 'deprecated' ELSE 'stale' END AS status FROM documents""")
def stale(t: Tables) -> DataFrame:
    source = _sheets(t)
    kept = F.when(F.col("family_slug") == "en", qu.source_revision(source)).otherwise(F.sha2(F.lit("old"), 256))
    other = source.withColumns({"source_revision": kept, "locale": F.lit("en-US"), "status": F.when(F.col("family_slug") == "fr", "deprecated").otherwise(F.col("status"))})
    return qu.revised(source.unionByName(other)).where("locale = 'en-US'").select("slug", "status")


@query("i04_withdrawn", "SELECT 'doc-' || doc_id AS slug, CASE WHEN n_chars > 500 THEN 'published' ELSE 'deprecated' END AS status FROM documents")
def withdrawn(t: Tables) -> DataFrame:
    before = _sheets(t)
    now = before.where(F.length(F.get("sections", 0)["text"]) > 500)
    return qu.carry_withdrawn(before, now).select("slug", "status")


@query("i05_public_content", """
    SELECT 'doc-' || d.doc_id AS slug, CAST(CASE WHEN l.quality = 1 AND source <> 'src3' THEN 1 ELSE 0 END AS BIGINT) AS blocks, CAST(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS BIGINT) AS readings,
           CASE WHEN l.quality = 1 AND source <> 'src3' THEN md5(d.text) END AS digest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def public(t: Tables) -> DataFrame:
    return qu.public_content(_sheets(t)).select(
        "slug", F.size("sections").cast("bigint").alias("blocks"), F.size("further_reading").cast("bigint").alias("readings"), F.md5(F.get("sections", 0)["text"]).alias("digest")
    )


@query("i06_split_and_expand", """
    SELECT 'doc-' || doc_id AS slug, md5(text) AS digest, source AS source_id, CAST(1 AS BIGINT) AS citations FROM documents""")
def split(t: Tables) -> DataFrame:
    back = qu.expand_sheets(qu.split_sheets(_sheets(t)))
    return back.select(
        "slug", F.md5(F.get("sections", 0)["text"]).alias("digest"), F.get("sources", 0)["id"].alias("source_id"), F.size(F.get("sections", 0)["citations"]).cast("bigint").alias("citations")
    )


@query("i06_snapshot_faults", "SELECT 'unknown_entity' AS fault, CAST(count(*) AS BIGINT) AS keys FROM documents WHERE lang = 'de'")
def faults(t: Tables) -> DataFrame:
    parts = qu.split_sheets(_sheets(t))
    parts["entities"] = parts["entities"].where("family_slug <> 'de' or family_slug is null")
    return qu.snapshot_faults(parts).groupBy("fault").agg(F.count(F.lit(1)).alias("keys"))
