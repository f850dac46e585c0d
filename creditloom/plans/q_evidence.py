"""Queries over sources, predicates, evidence, serving and mapping."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn
from ..config import DEFAULT, SERVING_SCHEMA
from ..operators import counts as co
from ..operators import evidence as ev
from ..operators import mapping as mp
from ..operators import serving as sv
from ..schemas import DUMP_TABLES, SHARDS
from ..sources import dump as dp
from ..sources import history as hi
from ..session import stored
from ..sources.sinks import manifest_gate, open_documents, shard_documents, stats_after, table_stats_frame
from .bridge import SNAPSHOT, Tables
from .oracle import _method
from .registry import query

SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _copy_escape(c):
    """COPY text of a value, as the database writes it."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, letter in (("\t", "t"), ("\n", "n"), ("\r", "r")):
        out = F.replace(out, F.lit(char), F.lit(f"\\{letter}"))
    return out


# ---- sources

@query("a01_copy_text_scan", "SELECT doc_id AS id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS characters, lang FROM documents")
def copy_text(t: Tables) -> DataFrame:
    lines = t.table("documents").select(
        F.concat_ws("\t", F.col("doc_id").cast("string"), _copy_escape(F.col("text")), F.coalesce(F.col("lang"), F.lit("\\N"))).alias("value")
    )
    rows = dp.copy_rows(lines, DUMP_TABLES["artist"])
    return rows.select(
        F.col("id").cast("bigint").alias("id"), F.md5("gid").alias("digest"), F.length("gid").cast("bigint").alias("characters"), F.col("name").alias("lang")
    )


@query("a02_projected_table_scan", "SELECT CAST(o_orderkey AS STRING) AS gid, CAST(o_custkey AS STRING) AS recording, o_orderpriority AS medium FROM orders")
def projected(t: Tables) -> DataFrame:
    cells = ["'0'", "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)", "o_orderpriority", "'\\\\N'", "'tail'"]
    return dp.copy_rows(t.table("orders").select(F.concat_ws("\t", *[F.expr(c) for c in cells]).alias("value")), DUMP_TABLES["track"])


@query("a04_positional_json_rows", "SELECT CAST(c_custkey AS STRING) AS link, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS artist, c_mktsegment AS recording FROM customer")
def json_rows(t: Tables) -> DataFrame:
    cells = F.array(F.col("c_custkey").cast("string"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")), F.col("c_mktsegment"))
    return dp.parse_json_rows(t.table("customer").select(F.to_json(cells, {"ignoreNullFields": "false"}).alias("value")), DUMP_TABLES["l_artist_recording"])


@query("a05_typed_json_defaults", """
    SELECT recording_mbid, CASE l_returnflag WHEN 'A' THEN 'recording' ELSE 'release' END AS scope,
           CASE l_linestatus WHEN 'F' THEN 'instrument' ELSE 'vocal' END AS relation_type, 'performed' AS production_method, CAST(count(*) AS BIGINT) AS credits
    FROM (SELECT CAST(l_partkey AS STRING) AS recording_mbid, l_returnflag, l_linestatus FROM lineitem) GROUP BY ALL""")
def typed_json(t: Tables) -> DataFrame:
    line = t.table("lineitem").select(F.to_json(F.struct(
        F.col("l_partkey").cast("string").alias("recording_mbid"),
        F.when(F.col("l_returnflag") != "A", "release").alias("scope"),
        F.when(F.col("l_linestatus") != "F", "vocal").alias("relation_type"),
    )).alias("value"))
    rows = dp.parse_typed_json(line, "recording_mbid string, scope string, relation_type string, production_method string", dp.EVIDENCE_DEFAULTS)
    return rows.groupBy("recording_mbid", "scope", "relation_type", "production_method").agg(F.count(F.lit(1)).alias("credits"))


@query("a06_strict_casts", """
    SELECT coalesce(reject_reason, 'accepted') AS outcome, CAST(count(*) AS BIGINT) AS rows_seen FROM (
      SELECT CASE WHEN l_tax > 0.075 THEN 'l_artist_recording.artist is missing or not valid'
                  WHEN l_quantity > 45 THEN 'l_artist_recording.recording is missing or not valid' END AS reject_reason FROM lineitem) GROUP BY ALL""")
def casts(t: Tables) -> DataFrame:
    raw = t.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("link"),
        F.when(F.col("l_tax") > 0.075, "").otherwise(F.col("l_suppkey").cast("string")).alias("artist"),
        F.when(F.col("l_quantity") > 45, "4294967296").otherwise(F.col("l_partkey").cast("string")).alias("recording"),
    )
    judged = dp.typed_table("l_artist_recording", raw, permissive=True)
    return judged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows_seen"))


_LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS STRING) AS lane{i}" for i in range(8))


@query("a07_table_digest", f"""
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(strlen(j)) AS BIGINT) AS bytes, {_LANES} FROM (
      SELECT j, sha256(j) AS h FROM (SELECT '{{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey
        || ',"l_returnflag":"' || l_returnflag || '"}}' AS j FROM lineitem))""")
def digest(t: Tables) -> DataFrame:
    stats = table_stats_frame(t.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"))
    return stats.select("rows", "bytes", *[F.col(f"lane{i}").cast("string").alias(f"lane{i}") for i in range(8)])


@query("a07_digest_after_upsert", f"""
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(strlen(j)) AS BIGINT) AS bytes, {_LANES} FROM (
      SELECT j, sha256(j) AS h FROM (SELECT '{{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey
        || ',"l_returnflag":"' || CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE l_returnflag END || '"}}' AS j FROM lineitem WHERE l_linenumber < 7))""")
def digest_after(t: Tables) -> DataFrame:
    """The digest kept up: returned lines are replaced, seventh lines deleted; only these are read again."""
    old = t.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    new = old.where("l_returnflag = 'R'").withColumn("l_returnflag", F.lit("returned"))
    # These lines have no key of their own, so the change is told by its rows.
    stats = stats_after(table_stats_frame(old), old.where("l_returnflag = 'R' or l_linenumber = 7"), new.where("l_linenumber < 7"))
    return stats.select("rows", "bytes", *[F.col(f"lane{i}").cast("string").alias(f"lane{i}") for i in range(8)])


@query("a08_shard_documents", """
    SELECT substr(track_mbid, 1, 3) AS shard, CAST(count(DISTINCT track_mbid) AS BIGINT) AS aliases, min(track_mbid) AS first_track, max(track_mbid) AS last_track
    FROM o_alias WHERE recording_mbid IN (SELECT recording_mbid FROM o_evidence) GROUP BY 1""")
def shards(t: Tables) -> DataFrame:
    # Sizing and placing both read the aliases.
    docs = shard_documents(_stored_aliases(_served_aliases(t)), "track", SNAPSHOT, 3)
    keys = F.map_keys("aliases")
    return docs.groupBy("shard").agg(
        F.sum(F.size("aliases")).alias("aliases"), F.min(F.array_min(keys)).alias("first_track"), F.max(F.array_max(keys)).alias("last_track")
    )


@query("a09_shard_read", """
    SELECT 'track' AS kind, track_mbid AS key, min(recording_mbid) AS value FROM o_alias WHERE recording_mbid IN (SELECT recording_mbid FROM o_evidence) GROUP BY track_mbid
    UNION ALL SELECT 'recording', recording_mbid, CAST(count(*) AS STRING) FROM o_claims GROUP BY recording_mbid""")
def shard_read(t: Tables) -> DataFrame:
    """Documents as text, parsed and opened again."""
    def reopened(rows: DataFrame, kind: str) -> DataFrame:
        text = shard_documents(rows, kind, SNAPSHOT, 2).select("shard", F.to_json(F.struct("*")).alias("line"))
        docs = text.select(F.col("shard").alias("_folder"), F.from_json("line", SHARDS[kind]).alias("d")).select("_folder", "d.*")
        return open_documents(docs, kind, SNAPSHOT)

    # As in the serving stage, each table is made once and read by all steps after it.
    supported = _supported(t)
    evidence = stored(_evidence_over(supported), "evidence")
    aliases = _stored_aliases(sv.unique_aliases(_servable_over(supported, evidence)))
    tracks = reopened(aliases, "track").select(F.lit("track").alias("kind"), "key", "value")
    recordings = reopened(stored(_documents(evidence), "documents"), "recording")
    claims = F.size("value.claims").cast("string").alias("value")
    return tracks.unionByName(recordings.select(F.lit("recording").alias("kind"), "key", claims))


@query("a03_dump_discovery", r"""
    SELECT regexp_replace(regexp_extract(url, '[^/]*$'), '\.(bz2|gz|tsv|txt)$', '') AS name, min(url) AS path FROM (
      SELECT url || CASE WHEN length(html) > 4000 THEN '.gz' WHEN length(html) > 3000 THEN '.tsv' ELSE '' END AS url FROM pages) GROUP BY 1""")
def discovery(t: Tables) -> DataFrame:
    size = F.length("html")
    ending = F.when(size > 4000, ".gz").when(size > 3000, ".tsv").otherwise("")
    return dp.least_paths(t.table("pages").select(F.concat("url", ending).alias("path")))


@query("a10_manifest_gate", f"""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'unsupported schema: old' WHEN o_orderpriority LIKE '1%' THEN 'snapshot mismatch: found 2023-z, requested {SNAPSHOT}' END AS fault FROM orders""")
def manifest(t: Tables) -> DataFrame:
    rows = t.table("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "old").otherwise(SERVING_SCHEMA).alias("schema_version"),
        F.when(F.col("o_orderpriority").startswith("1"), "2023-z").otherwise(SNAPSHOT).alias("snapshot_version"),
    )
    return manifest_gate(rows, SERVING_SCHEMA, SNAPSHOT).select("o_orderkey", "fault")


@query("a13_reference_dimensions", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'drums' WHEN 1 THEN 'cello' WHEN 2 THEN 'cello' END AS instrument_slug,
           CASE p_size % 4 WHEN 0 THEN 'percussion' WHEN 1 THEN 'bowed-strings' WHEN 2 THEN 'bowed-strings' END AS family_slug,
           CASE p_size % 4 WHEN 0 THEN 'acoustic' WHEN 1 THEN 'acoustic' WHEN 2 THEN 'acoustic' END AS family_nature FROM part""")
def dimensions(t: Tables) -> DataFrame:
    """Parts named by alias, by external id, by both and by neither."""
    kind = F.col("p_size") % 4
    rows = t.table("part").select(
        "p_partkey", F.when(kind == 0, "Drums (drum set)").when(kind == 2, "Drum kit").otherwise("kazoo").alias("instrument_name"),
        F.when(kind.isin(1, 2), "e0000004-0000-4000-8000-000000000004").alias("instrument_mbid"),
    )
    return mp.resolve(rows, t.taxonomy).join(t.taxonomy.families, "family_slug", "left").select("p_partkey", "instrument_slug", "family_slug", "family_nature")


@query("a11_history_pages", """
    SELECT listener, period, rank, title, trim(artist) AS artist, play_count, mbid, artist_mbid FROM (
      SELECT CAST(listener AS STRING) AS listener, period, rank, title, artist, play_count,
             CASE WHEN regexp_matches(mbid, '^.{14}[1-8].{4}[89ab]') THEN mbid END AS mbid,
             CASE WHEN regexp_matches(artist_mbid, '^.{14}[1-8].{4}[89ab]') THEN artist_mbid END AS artist_mbid FROM history)""")
def pages(t: Tables) -> DataFrame:
    artist = F.struct(F.concat(F.lit(" "), F.col("artist")).alias("name"), F.col("artist_mbid").alias("mbid"))
    track = F.struct(F.col("rank"), F.struct(F.col("title").alias("name"), F.col("play_count").cast("string").alias("playcount"), "mbid", artist.alias("artist")).alias("t"))
    page = t.view("history").withColumn("page", F.ceil(F.col("rank") / DEFAULT.page_size).cast("bigint"))
    # A page is at most page_size rows by its own key.
    payloads = page.groupBy(F.col("listener").cast("string").alias("listener"), "period", "page").agg(F.array_sort(F.collect_list(track)).alias("ts"))
    body = F.to_json(F.struct(F.struct(F.transform("ts", lambda x: x["t"]).alias("track")).alias("toptracks")))
    return hi.parse_pages(payloads.select("listener", "period", "page", body.alias("payload"))).select(
        "listener", "period", "rank", "title", "artist", "play_count", "mbid", "artist_mbid"
    )


@query("a11_page_rejects", """
    WITH tracks AS (
      SELECT CAST(o_custkey AS STRING) AS listener, 'overall' AS period, o_orderkey,
             CASE WHEN o_orderkey % 5 = 0 THEN 'page' ELSE CASE WHEN length(title) = 0 THEN 'missing_title' WHEN length(title) > 512 THEN 'title_too_long'
                  WHEN length(artist) = 0 THEN 'missing_artist' WHEN length(artist) > 256 THEN 'artist_too_long' WHEN plays < 0 THEN 'invalid_play_count' END END AS reason
      FROM (SELECT o_custkey, o_orderkey, repeat(o_orderpriority, o_orderkey % 90) AS title, repeat(o_orderstatus, o_orderkey % 300) AS artist,
                   CASE WHEN o_orderpriority LIKE '1%' THEN -1 ELSE 1 END AS plays FROM orders))
    SELECT listener, period, reason AS reject_reason, CAST(count(*) AS BIGINT) AS rows FROM tracks WHERE reason <> 'page' GROUP BY ALL
    UNION ALL SELECT listener, period, 'not_a_history_page', CAST(count(*) AS BIGINT) FROM tracks WHERE reason = 'page' GROUP BY ALL
    UNION ALL SELECT CAST(o_custkey AS STRING), 'all', 'page_too_large', CAST(1 AS BIGINT) FROM orders GROUP BY o_custkey HAVING count(*) > 15""")
def rejects(t: Tables) -> DataFrame:
    """One page an order; every fifth holds no history, and one more page lists all orders of a listener."""
    orders = t.table("orders")
    key, listener = F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("listener")
    plays = F.when(F.col("o_orderpriority").startswith("1"), -1).otherwise(1)
    track = F.struct(F.expr("repeat(o_orderpriority, int(o_orderkey % 90))").alias("name"), plays.alias("playcount"), F.expr("repeat(o_orderstatus, int(o_orderkey % 300))").alias("artist"))
    body = F.when(key % 5 == 0, F.lit('{"history": []}')).otherwise(F.to_json(F.struct(F.struct(track.alias("track")).alias("toptracks"))))
    single = orders.select(listener, F.lit("overall").alias("period"), key.alias("page"), body.alias("payload"))
    # Bounded by the orders of one customer.
    short = F.struct(F.lit("x").alias("name"), F.lit(1).alias("playcount"), F.lit("y").alias("artist"))
    whole = orders.groupBy("o_custkey").agg(F.collect_list(short).alias("ts")).select(
        listener, F.lit("all").alias("period"), F.lit(1).cast("bigint").alias("page"), F.to_json(F.struct(F.struct(F.col("ts").alias("track")).alias("toptracks"))).alias("payload")
    )
    return hi.page_rejects(single.unionByName(whole), replace(DEFAULT, page_size=15))


@query("a12_profiles", """
    SELECT CAST(c_custkey AS STRING) AS listener, c_name AS username, 'https://www.last.fm/user/' || replace(c_name, '#', '%23') AS profile_url,
           CASE WHEN c_nationkey < 12 THEN 'https://lastfm.freetls.fastly.net/i/u/' || c_nationkey || '.png' END AS avatar_url, c_mktsegment AS realname,
           strftime(make_timestamp(CAST(c_custkey AS BIGINT) * 1000000 * 3600), '%Y-%m-%dT%H:%M:%S.000Z') AS registered FROM customer""")
def profiles(t: Tables) -> DataFrame:
    host = F.when(F.col("c_nationkey") < 12, "lastfm.freetls.fastly.net").otherwise("example.org")
    image = F.array(F.struct(F.lit("not a url").alias("#text")), F.struct(F.concat(F.lit("https://"), host, F.lit("/i/u/"), F.col("c_nationkey"), F.lit(".png")).alias("#text")))
    user = F.struct(
        F.lit("https://example.org/x").alias("url"), image.alias("image"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("realname"),
        F.struct((F.col("c_custkey") * 3600).cast("string").alias("unixtime")).alias("registered"),
    )
    payload = F.to_json(F.struct(F.col("c_name").alias("username"), user.alias("profile")))
    # Parsing costs far more than reading: rows are dealt to all cores, however few row groups the file has.
    customers = t.table("customer").repartition("c_custkey")
    return hi.parse_profiles(customers.select(F.col("c_custkey").cast("string").alias("listener"), payload.alias("payload")))


# ---- predicates

@query("b01_supported_relations", """
    SELECT relation_type, CAST(count(*) AS BIGINT) AS links FROM o_typed GROUP BY 1""")
def supported(t: Tables) -> DataFrame:
    return ev.typed_links(t.view("d_link"), t.view("d_link_type")).groupBy("relation_type").agg(F.count(F.lit(1)).alias("links"))


@query("b02_canonical_ids", """
    SELECT id, CASE WHEN regexp_full_match(u, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN u END AS loose,
           CASE WHEN regexp_full_match(u, '[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') THEN u END AS strict
    FROM (SELECT recording_mbid AS id, lower(trim(recording_mbid, ' ' || chr(9) || chr(160))) AS u FROM raw_evidence)""")
def canonical(t: Tables) -> DataFrame:
    c = F.col("id")
    return t.view("raw_evidence").select(F.col("recording_mbid").alias("id")).select("id", fn.canonical_mbid(c).alias("loose"), fn.canonical_mbid(c, True).alias("strict"))


@query("b03_slugs", """
    SELECT name, CASE WHEN regexp_full_match(trim(name), '[a-z0-9]+(-[a-z0-9]+)*') AND length(trim(name)) <= 80 THEN trim(name) END AS slug
    FROM (SELECT CASE WHEN p_size > 25 THEN replace(p_name, ' ', '-') ELSE p_name END || CASE WHEN p_size > 45 THEN '-' ELSE ' ' END AS name FROM part)""")
def slugs(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") > 25, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name"))
    tail = F.when(F.col("p_size") > 45, "-").otherwise(" ")
    return t.table("part").select(F.concat(name, tail).alias("name")).select("name", fn.valid_slug(F.col("name")).alias("slug"))


@query("b04_placeholder_artists", """
    SELECT CASE WHEN lower(trim(artist_name)) IN ('[unknown]', '[anonymous]', '[no artist]', '[test]', 'various artists') THEN 'special_artist' ELSE 'accepted' END AS outcome,
           CAST(count(*) AS BIGINT) AS entries FROM o_vocabulary GROUP BY 1""")
def placeholders(t: Tables) -> DataFrame:
    judged = sv.judge_vocabulary(_vocabulary(t))
    return judged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("entries"))


_JUDGED = """
    SELECT CASE WHEN recording_mbid IS NULL THEN 'invalid_evidence' WHEN relation_type = 'instrument' AND instrument_mbid = '' THEN 'unresolved_instrument'
                WHEN instrument_name = '' THEN 'invalid_evidence' WHEN scope NOT IN ('recording', 'release') THEN 'invalid_evidence' ELSE 'accepted' END AS outcome,
           relation_type, scope, production_method,
           array_to_string(list_sort(list_distinct(list_append(list_filter(list_transform(string_split(attribute_text, '|'), lambda x: trim(x, ' ' || chr(9) || chr(160))), lambda x: x <> ''), instrument_name))), '|') AS attributes,
           CAST(count(*) AS BIGINT) AS credits, CAST(count(nullif(trim(performer, ' ' || chr(9) || chr(160)), '')) AS BIGINT) AS performers, CAST(count(nullif(source_url, '')) AS BIGINT) AS sources
    FROM (SELECT CASE WHEN trim(recording_mbid, ' ' || chr(9) || chr(160)) <> 'no-id' THEN lower(trim(recording_mbid, ' ' || chr(9) || chr(160))) END AS recording_mbid, instrument_mbid, trim(instrument_name, ' ' || chr(9) || chr(160)) AS instrument_name, attribute_text,
                 CASE WHEN trim(relation_type, ' ' || chr(9) || chr(160)) = '' THEN 'instrument' ELSE lower(trim(relation_type, ' ' || chr(9) || chr(160))) END AS relation_type,
                 CASE WHEN trim(scope, ' ' || chr(9) || chr(160)) = '' THEN 'recording' ELSE trim(scope, ' ' || chr(9) || chr(160)) END AS scope,
                 CASE WHEN trim(production_method, ' ' || chr(9) || chr(160)) = '' THEN 'performed' ELSE trim(production_method, ' ' || chr(9) || chr(160)) END AS production_method, performer, source_url FROM raw_evidence)
    GROUP BY ALL"""


@query("b05_evidence_normalization", _JUDGED)
def judged(t: Tables) -> DataFrame:
    raw = t.view("raw_evidence").withColumn("attributes", F.split("attribute_text", r"\|"))
    out = sv.judge_evidence(raw, SNAPSHOT).withColumns({"outcome": F.coalesce("reject_reason", F.lit("accepted")), "attributes": F.array_join("attributes", "|")})
    return out.groupBy("outcome", "relation_type", "scope", "production_method", "attributes").agg(
        F.count(F.lit(1)).alias("credits"), F.count("performer").alias("performers"), F.count("source_url").alias("sources")
    )


@query("b06_production_methods", f"""
    SELECT relation_type, {_method('relation_type')} AS production_method, CASE WHEN relation_type IN ('vocal', 'vocals') THEN 'voice' ELSE relation_type END AS fallback_name,
           CAST(count(*) AS BIGINT) AS links FROM o_typed GROUP BY ALL""")
def methods(t: Tables) -> DataFrame:
    r = F.col("relation_type")
    links = ev.typed_links(t.view("d_link"), t.view("d_link_type"))
    return links.groupBy("relation_type", ev.production_method(r).alias("production_method"), ev.fallback_name(r).alias("fallback_name")).agg(F.count(F.lit(1)).alias("links"))


@query("b07_direct_scope", "SELECT scope, CAST(count(*) AS BIGINT) AS claims FROM o_claims WHERE scope IN ('recording', 'track') GROUP BY 1")
def direct_scope(t: Tables) -> DataFrame:
    return mp.direct_only(_claims(t)).groupBy("scope").agg(F.count(F.lit(1)).alias("claims"))


@query("b11_bounded_text", rf"""
    SELECT doc_id, CASE WHEN length(s) BETWEEN 1 AND 512 THEN md5(s) END AS short_digest, CASE WHEN length(s) BETWEEN 1 AND 20000 THEN CAST(length(s) AS BIGINT) END AS long_length
    FROM (SELECT doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS s FROM documents)""")
def bounded(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.table("documents").select("doc_id", F.md5(fn.bounded_text(text)).alias("short_digest"), F.length(fn.bounded_text(text, 20000)).cast("bigint").alias("long_length"))


@query("b11_safe_urls", r"""
    SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^@/?#]+([/?#]|$)') THEN u END AS safe FROM (
      SELECT page_id, CASE WHEN length(html) > 4000 THEN replace(url, '://', '://user:pw@') WHEN length(html) > 3000 THEN replace(url, 'http', 'ftp') ELSE url END AS u FROM pages)""")
def urls(t: Tables) -> DataFrame:
    size = F.length("html")
    url = F.when(size > 4000, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).when(size > 3000, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))
    return t.table("pages").select("page_id", fn.http_url(url).alias("safe"))


# ---- evidence joins

@query("c01_relation_typing", "SELECT link, relation_type FROM o_typed")
def typing(t: Tables) -> DataFrame:
    return ev.typed_links(t.view("d_link"), t.view("d_link_type"))


@query("c02_attribute_instruments", """
    SELECT attribute_name, instrument_mbid, CAST(count(*) AS BIGINT) AS uses FROM o_attr GROUP BY 1, 2""")
def attribute_instruments(t: Tables) -> DataFrame:
    types = ev.attribute_instruments(t.view("d_link_attribute_type"), t.view("d_instrument"))
    return ev.link_attributes(t.view("d_link_attribute"), types).groupBy("attribute_name", "instrument_mbid").agg(F.count(F.lit(1)).alias("uses"))


@query("c03_link_attributes", "SELECT link, attribute_type, attribute_name FROM o_attr")
def attributes(t: Tables) -> DataFrame:
    types = ev.attribute_instruments(t.view("d_link_attribute_type"), t.view("d_instrument"))
    return ev.link_attributes(t.view("d_link_attribute"), types).select("link", "attribute_type", "attribute_name")


@query("c04_credited_names", "SELECT link, attribute_type, credited AS original_credit FROM o_credited")
def credited(t: Tables) -> DataFrame:
    return ev.credited_names(t.view("d_link_attribute_credit"))


@query("d01_link_relations", """
    SELECT link, relation_type, coalesce(array_to_string(attributes, '|'), '') AS attributes, coalesce(instruments, '') AS instruments, credited AS original_credit FROM o_relation""")
def relations(t: Tables) -> DataFrame:
    rows = _relations(t)
    ids = F.array_join(F.transform("instruments", lambda i: i["instrument_mbid"]), "|").alias("instruments")
    return rows.select("link", "relation_type", F.array_join("attributes", "|").alias("attributes"), ids, "original_credit")


_DIRECT = ["recording_mbid", "recording_title", "artist_mbid", "performer", "instrument_mbid", "instrument_name", "attributes", "original_credit",
           "scope", "relation_type", "production_method", "source_url"]


@query("c05_direct_evidence", f"SELECT {', '.join(_DIRECT)} FROM o_direct")
def direct(t: Tables) -> DataFrame:
    return _direct(t).withColumn("attributes", F.array_join(F.array_sort("attributes"), "|")).select(*_DIRECT)


@query("c06_release_context", f"SELECT release_mbid, release_title, {', '.join(_DIRECT)} FROM o_release")
def release(t: Tables) -> DataFrame:
    return _release(t).withColumn("attributes", F.array_join(F.array_sort("attributes"), "|")).select("release_mbid", "release_title", *_DIRECT)


@query("c07_relevant_entities", """
    SELECT 'recording' AS kind, CAST(recording AS BIGINT) AS id FROM o_relevant
    UNION ALL SELECT DISTINCT 'artist', CAST(artist AS BIGINT) FROM (SELECT artist, link FROM d_l_artist_recording UNION ALL SELECT artist, link FROM d_l_artist_release) JOIN o_typed USING (link)""")
def relevant(t: Tables) -> DataFrame:
    tables = t.dump()
    links = ev.typed_links(tables["link"], tables["link_type"])
    recordings = ev.relevant_recordings(tables, links).select(F.lit("recording").alias("kind"), F.col("recording").alias("id"))
    return recordings.unionByName(ev.relevant_artists(tables, links).select(F.lit("artist").alias("kind"), F.col("artist").alias("id")))


@query("c08_track_aliases", "SELECT track_mbid, recording_mbid, 'https://musicbrainz.org/track/' || track_mbid AS source_url FROM o_alias")
def aliases(t: Tables) -> DataFrame:
    return _aliases(t).select("track_mbid", "recording_mbid", "source_url")


@query("d02_recurrence_vocabulary", """
    SELECT artist_mbid, artist_name, instrument_mbid, instrument_name, distinct_recordings, documented_recordings, prevalence, qualifying FROM o_vocabulary""")
def vocabulary(t: Tables) -> DataFrame:
    return _vocabulary(t).drop("snapshot_version")


@query("d02_mergeable_counts", """
    SELECT l_suppkey AS artist, CAST(l_linenumber AS BIGINT) AS instrument, CAST(count(DISTINCT l_partkey) FILTER (l_linestatus = 'F') AS BIGINT) AS before,
           CAST(count(DISTINCT l_partkey) AS BIGINT) AS recordings
    FROM line WHERE type_id = 1 GROUP BY 1, 2""")
def mergeable_counts(t: Tables) -> DataFrame:
    """Distinct recordings per artist and instrument after a second snapshot, from the bitmaps of both."""
    keys = ["artist", "instrument"]
    rows = t.view("line").where("type_id = 1").select(F.col("l_suppkey").alias("artist"), F.col("l_linenumber").alias("instrument"), "l_linestatus", "l_partkey")
    first, second = (co.distinct_bitmaps(rows.where(F.col("l_linestatus") == s), keys, F.col("l_partkey")) for s in ("F", "O"))
    both = co.distinct_counts(co.unite(first, second), keys, "recordings")
    return both.join(co.distinct_counts(first, keys, "before"), keys, "left").select(*keys, F.coalesce("before", F.lit(0)).cast("bigint").alias("before"), "recordings")


# ---- serving

def _relations(t: Tables) -> DataFrame:
    return t.built("relations", lambda t: ev.link_relations(t.dump()))


def _direct(t: Tables) -> DataFrame:
    return t.built("direct", lambda t: ev.direct_evidence(t.dump(), _relations(t), SNAPSHOT))


def _release(t: Tables) -> DataFrame:
    return t.built("release", lambda t: ev.release_context(t.dump(), _relations(t), SNAPSHOT))


def _aliases(t: Tables) -> DataFrame:
    links = ev.typed_links(t.view("d_link"), t.view("d_link_type"))
    return t.built("aliases", lambda t: ev.track_aliases(t.dump(), links, SNAPSHOT))


def _vocabulary(t: Tables) -> DataFrame:
    return t.built("vocabulary", lambda t: ev.recurrence_vocabulary(_direct(t), SNAPSHOT))


def _judged(t: Tables) -> DataFrame:
    return t.built("judged", lambda t: sv.judge_evidence(sv.union_evidence(_direct(t).drop("recording", "artist"), _release(t)), SNAPSHOT))


def _supported(t: Tables) -> Tables:
    """Tables over the order lines of supported relations alone, joined to their parts and written once a job.

    Every dump table of links is a view over these lines, and evidence takes no others."""
    types = ev.supported_types(t.view("d_link_type")).select(F.col("link_type").alias("type_id"))
    return t.over("line", stored(t.view("line").drop("l_quantity").join(types, "type_id", "left_semi"), "line"))


def _evidence_over(supported: Tables) -> DataFrame:
    return sv.dump_evidence(supported.dump(), _relations(supported), keep=lambda rows: stored(rows, "links"))


def _evidence(t: Tables) -> DataFrame:
    return _evidence_over(_supported(t))


def _credits(t: Tables) -> DataFrame:
    return sv.dedupe_credits(_evidence(t))


def _claims_over(supported: Tables) -> DataFrame:
    return sv.aggregate_claims(sv.dedupe_credits(_evidence_over(supported)))


def _claims(t: Tables) -> DataFrame:
    return _claims_over(_supported(t))


def _served_vocabulary(t: Tables) -> DataFrame:
    return t.built("served_vocabulary", lambda t: sv.dedupe_vocabulary(sv.accepted(sv.judge_vocabulary(_vocabulary(t)))))


def _served_aliases(t: Tables, packed: bool = False) -> DataFrame:
    return _served_over(_supported(t), packed)


def _served_over(supported: Tables, packed: bool = False) -> DataFrame:
    return sv.unique_aliases(_servable(supported), packed)


def _servable(supported: Tables) -> DataFrame:
    # What release evidence gives way to is of the same recording, so accepted rows name the same recordings.
    return _servable_over(supported, sv.accepted(_judged(supported)))


def _servable_over(supported: Tables, evidence: DataFrame) -> DataFrame:
    """Accepted aliases of the recordings that evidence serves, which is known before tracks join them."""
    def served(recordings: DataFrame) -> DataFrame:
        return sv.servable_aliases(recordings.withColumn("recording_mbid", fn.canonical_mbid(F.col("recording_mbid"))), evidence)

    links = ev.typed_links(supported.view("d_link"), supported.view("d_link_type"))
    return sv.accepted(sv.judge_aliases(ev.track_aliases(supported.dump(), links, SNAPSHOT, keep=served)))


def _stored_aliases(aliases: DataFrame) -> DataFrame:
    """Documents of aliases, written once with their ids packed."""
    rows = sv.alias_documents(aliases)
    kept = stored(rows.select(*[fn.packed_id(F.col(c)).alias(c) for c in rows.columns]), "aliases")
    return kept.select(*[fn.unpacked_id(F.col(c)).alias(c) for c in rows.columns])


def _documents(evidence: DataFrame) -> DataFrame:
    """Recording documents of stored evidence; claims and sources are each read several times."""
    claims = stored(sv.aggregate_claims(sv.dedupe_credits(evidence)), "claims")
    return sv.recording_documents(claims, stored(sv.claim_sources(evidence), "sources"))


@query("f01_union_evidence", """
    SELECT scope, relation_type, CAST(count(*) AS BIGINT) AS credits, CAST(count(release_mbid) AS BIGINT) AS with_release FROM (
      SELECT scope, relation_type, NULL AS release_mbid FROM o_direct UNION ALL SELECT scope, relation_type, release_mbid FROM o_release) GROUP BY 1, 2""")
def union_evidence(t: Tables) -> DataFrame:
    both = sv.union_evidence(_direct(t), _release(t))
    return both.groupBy("scope", "relation_type").agg(F.count(F.lit(1)).alias("credits"), F.count("release_mbid").alias("with_release"))


@query("c09_direct_before_release", "SELECT recording_mbid, min(scope) AS scope, CAST(count(*) AS BIGINT) AS credits FROM o_evidence GROUP BY 1")
def fallback(t: Tables) -> DataFrame:
    return _evidence(t).groupBy("recording_mbid").agg(F.min("scope").alias("scope"), F.count(F.lit(1)).alias("credits"))


@query("c10_servable_aliases", "SELECT track_mbid, recording_mbid FROM o_alias WHERE recording_mbid IN (SELECT recording_mbid FROM o_evidence)")
def servable(t: Tables) -> DataFrame:
    return _servable(_supported(t)).select("track_mbid", "recording_mbid")


@query("d03_deduplicated_credits", """
    SELECT recording_mbid, artist_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method, performer, source_url FROM o_credits""")
def credits(t: Tables) -> DataFrame:
    return _credits(t).withColumn("attributes", F.array_join("attributes", "|"))


@query("d03_credit_sources", "SELECT DISTINCT recording_mbid, artist_mbid, instrument_name, relation_type, attributes, source_url FROM o_evidence")
def sources(t: Tables) -> DataFrame:
    # Direct rows are read twice, to be kept and to displace release rows; all their texts are wanted.
    accepted = sv.accepted(_judged(t)).select("recording_mbid", *sv.CREDIT_IDENTITY, "source_url")
    rows = sv.credit_sources(sv.prefer_direct(stored(accepted, "evidence"))).withColumn("attributes", F.array_join("attributes", "|"))
    return rows.select("recording_mbid", "artist_mbid", "instrument_name", "relation_type", "attributes", "source_url").distinct()


@query("d04_claims", """
    SELECT recording_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method, CAST(credit_count AS BIGINT) AS credit_count,
           CAST(performer_count AS BIGINT) AS performer_count, source_url FROM o_claims""")
def claims(t: Tables) -> DataFrame:
    return _claims(t).withColumn("attributes", F.array_join("attributes", "|"))


@query("d05_alias_uniqueness", """
    SELECT CAST(count(*) AS BIGINT) AS tracks, CAST(count(*) FILTER (n > 1) AS BIGINT) AS conflicts FROM (
      SELECT track_mbid, count(DISTINCT recording_mbid) AS n FROM o_alias GROUP BY 1)""")
def alias_uniqueness(t: Tables) -> DataFrame:
    rows = _aliases(t)
    clashes = sv.alias_conflicts(rows).select("track_mbid", F.lit(1).alias("c"))
    return sv.unique_aliases(rows).join(clashes, "track_mbid", "left").agg(F.count(F.lit(1)).alias("tracks"), F.count("c").alias("conflicts"))


@query("d06_vocabulary_deduplication", """
    SELECT artist_mbid, instrument_mbid, max(prevalence) AS prevalence, CAST(arg_max(distinct_recordings, prevalence) AS BIGINT) AS distinct_recordings FROM (
      SELECT artist_mbid, instrument_mbid, prevalence, distinct_recordings FROM o_vocabulary WHERE lower(artist_name) <> 'various artists'
      UNION ALL SELECT artist_mbid, instrument_mbid, prevalence / 2, distinct_recordings - 1 FROM o_vocabulary WHERE lower(artist_name) <> 'various artists') GROUP BY 1, 2""")
def vocabulary_dedupe(t: Tables) -> DataFrame:
    rows = _vocabulary(t)
    older = rows.withColumns({"prevalence": F.col("prevalence") / 2, "distinct_recordings": F.col("distinct_recordings") - 1})
    kept = sv.dedupe_vocabulary(sv.accepted(sv.judge_vocabulary(rows.unionByName(older))))
    return kept.select("artist_mbid", "instrument_mbid", "prevalence", "distinct_recordings")


@query("d07_stage_counters", """
    WITH arriving AS (
      SELECT recording_mbid, artist_mbid, CASE WHEN performer LIKE '%1' THEN NULL ELSE instrument_mbid END AS instrument_mbid,
             CASE WHEN performer LIKE '%2' AND relation_type <> 'instrument' THEN '' ELSE instrument_name END AS instrument_name,
             attributes, scope, relation_type, production_method, performer, source_url
      FROM (SELECT recording_mbid, artist_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method, performer, source_url FROM o_direct
            UNION ALL SELECT recording_mbid, artist_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method, performer, source_url FROM o_release)),
    judged AS (SELECT *, CASE WHEN relation_type = 'instrument' AND instrument_mbid IS NULL THEN 'unresolved' WHEN instrument_name = '' THEN 'invalid' END AS reason FROM arriving),
    good AS (SELECT * FROM judged WHERE reason IS NULL),
    shown AS (SELECT * FROM good WHERE scope <> 'release' OR recording_mbid NOT IN (SELECT recording_mbid FROM good WHERE scope <> 'release')),
    credit AS (SELECT DISTINCT recording_mbid, artist_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method, performer FROM shown),
    claim AS (SELECT recording_mbid, scope, count(*) AS credits FROM credit GROUP BY recording_mbid, instrument_mbid, instrument_name, attributes, scope, relation_type, production_method),
    alias AS (SELECT * FROM o_alias WHERE track_mbid NOT LIKE '0%'),
    entry AS (SELECT artist_name = 'Various Artists' AS special, instrument_name = 'cello' AS bad, qualifying FROM o_vocabulary)
    SELECT CAST((SELECT count(*) FROM judged) AS BIGINT) AS input_evidence_rows,
           CAST((SELECT count(*) FROM judged WHERE reason = 'unresolved') AS BIGINT) AS discarded_unresolved_instrument_rows,
           CAST((SELECT count(*) FROM judged WHERE reason = 'invalid') AS BIGINT) AS discarded_invalid_evidence_rows,
           CAST((SELECT count(DISTINCT recording_mbid) FROM claim) AS BIGINT) AS recording_count,
           CAST((SELECT coalesce(sum(credits), 0) FROM claim) AS BIGINT) AS credit_count, CAST((SELECT count(*) FROM claim) AS BIGINT) AS claim_count,
           CAST((SELECT count(DISTINCT recording_mbid) FROM claim WHERE scope = 'release') AS BIGINT) AS release_fallback_recordings,
           CAST((SELECT count(*) FROM alias WHERE recording_mbid IN (SELECT recording_mbid FROM claim)) AS BIGINT) AS alias_count,
           CAST((SELECT count(*) FROM alias WHERE recording_mbid NOT IN (SELECT recording_mbid FROM claim)) AS BIGINT) AS orphan_alias_count,
           CAST((SELECT count(*) FROM o_alias WHERE track_mbid LIKE '0%') AS BIGINT) AS discarded_invalid_alias_rows,
           CAST((SELECT count(*) FROM entry WHERE NOT special AND NOT bad) AS BIGINT) AS vocabulary_entries,
           CAST((SELECT count(*) FROM entry WHERE NOT special AND NOT bad AND qualifying) AS BIGINT) AS qualifying_vocabulary_entries,
           CAST((SELECT count(*) FROM entry WHERE NOT special AND bad) AS BIGINT) AS discarded_invalid_vocabulary_rows,
           CAST((SELECT count(*) FROM entry WHERE special) AS BIGINT) AS discarded_special_artist_rows""")
def counters(t: Tables) -> DataFrame:
    """Counters of a stage whose input has bad rows: instruments, names and ids are taken from some."""
    def spoiled(rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            "instrument_mbid": F.when(~F.coalesce(F.col("performer").endswith("1"), F.lit(False)), F.col("instrument_mbid")),
            "instrument_name": F.when(F.coalesce(F.col("performer").endswith("2"), F.lit(False)) & (F.col("relation_type") != "instrument"), F.lit("")).otherwise(F.col("instrument_name")),
        })

    # What several counters start from is written once; elsewhere fewer columns are wanted, and joining twice moves less.
    relations = stored(_relations(t), "relations")
    direct = stored(ev.direct_evidence(t.dump(), relations, SNAPSHOT), "direct")
    release = ev.release_context(t.dump(), relations, SNAPSHOT)
    aliases = ev.track_aliases(t.dump(), relations, SNAPSHOT)
    aliases = aliases.withColumn("recording_mbid", F.when(F.col("track_mbid").startswith("0"), F.lit("no-id")).otherwise(F.col("recording_mbid")))
    vocabulary = ev.recurrence_vocabulary(direct, SNAPSHOT).withColumn("instrument_mbid", F.when(F.col("instrument_name") != "cello", F.col("instrument_mbid")))
    served = sv.serve(spoiled(direct.drop("recording", "artist")), spoiled(release), aliases, vocabulary, SNAPSHOT, keep=lambda rows: stored(rows.drop("original_credit"), "judged"))
    return sv.stage_counters(served)


@query("b12_serving_documents", """
    SELECT recording_mbid, CAST(count(*) AS BIGINT) AS claims, CAST(sum(credit_count) AS BIGINT) AS credits, true AS valid FROM o_claims GROUP BY 1""")
def documents(t: Tables) -> DataFrame:
    from ..sources.sinks import valid_value

    docs = _documents(stored(_evidence(t), "evidence"))
    total = F.aggregate("value.claims", F.lit(0).cast("bigint"), lambda a, c: a + c["credit_count"])
    return docs.select(F.col("key").alias("recording_mbid"), F.size("value.claims").cast("bigint").alias("claims"), total.alias("credits"), valid_value("recording", F.col("value")).alias("valid"))


# ---- taxonomy

@query("f03_alias_dimension", """
    SELECT i.instrument_name, coalesce(s.claim_level, 'unmapped') AS claim_level, s.subject_slug, CAST(count(*) AS BIGINT) AS claims
    FROM o_claims i LEFT JOIN o_subject s USING (instrument_name) GROUP BY ALL""")
def alias_dimension(t: Tables) -> DataFrame:
    rows = mp.resolve(_claims(t), t.taxonomy)
    return rows.groupBy("instrument_name", F.coalesce("claim_level", F.lit("unmapped")).alias("claim_level"), "subject_slug").agg(F.count(F.lit(1)).alias("claims"))


@query("c15_taxonomy_mapping", """
    SELECT recording_mbid, instrument_mbid, instrument_name, scope, relation_type, claim_level, subject_slug, family_slug, CAST(credit_count AS BIGINT) AS credit_count
    FROM (SELECT recording_mbid, instrument_mbid, instrument_name, scope, relation_type, sum(credit_count) AS credit_count FROM o_claims GROUP BY ALL) JOIN o_subject USING (instrument_name)""")
def mapping(t: Tables) -> DataFrame:
    keys = ["recording_mbid", "instrument_mbid", "instrument_name", "scope", "relation_type"]
    merged = _claims(t).groupBy(*keys).agg(F.sum("credit_count").alias("credit_count"))
    return mp.resolve(merged, t.taxonomy).where("subject_slug is not null").select(*keys, "claim_level", "subject_slug", "family_slug", "credit_count")


@query("d08_recording_claims", "SELECT * FROM o_mapped")
def recording_claims(t: Tables) -> DataFrame:
    return mp.map_claims(_claims(t), t.taxonomy)


@query("d08_recording_totals", """
    SELECT recording_mbid, credit_count, mapped_credit_count, credit_count - mapped_credit_count AS discarded_credit_count,
           CASE WHEN mapped_credit_count > 0 THEN 'complete' ELSE 'complete_empty' END AS status FROM (
      SELECT recording_mbid, CAST(sum(credit_count) AS BIGINT) AS credit_count, CAST(coalesce(sum(credit_count) FILTER (s.subject_slug IS NOT NULL), 0) AS BIGINT) AS mapped_credit_count
      FROM o_claims LEFT JOIN o_subject s USING (instrument_name) GROUP BY 1)""")
def recording_totals(t: Tables) -> DataFrame:
    return mp.recording_totals(_claims(t), t.taxonomy)


@query("d09_artist_entries", """
    SELECT artist_mbid, subject_slug AS instrument_slug, family_slug, CAST(sum(distinct_recordings) AS BIGINT) AS distinct_recordings,
           CAST(sum(documented_recordings) AS BIGINT) AS documented_recordings, max(prevalence) AS prevalence, bool_or(qualifying) AS qualifying
    FROM o_vocabulary JOIN o_subject USING (instrument_name) WHERE claim_level = 'instrument' AND artist_name <> 'Various Artists' GROUP BY 1, 2, 3""")
def artist_entries(t: Tables) -> DataFrame:
    return mp.map_vocabulary(_served_vocabulary(t), t.taxonomy)


@query("d09_artist_totals", """
    SELECT artist_mbid, entry_count, mapped_entry_count, entry_count - mapped_entry_count AS discarded_entry_count,
           CASE WHEN mapped_entry_count > 0 THEN 'complete' ELSE 'complete_empty' END AS status FROM (
      SELECT artist_mbid, CAST(count(*) AS BIGINT) AS entry_count, CAST(count(*) FILTER (claim_level = 'instrument') AS BIGINT) AS mapped_entry_count
      FROM o_vocabulary LEFT JOIN o_subject USING (instrument_name) WHERE artist_name <> 'Various Artists' GROUP BY 1)""")
def artist_totals(t: Tables) -> DataFrame:
    return mp.artist_totals(_served_vocabulary(t), t.taxonomy)


_NAMES = """
    SELECT m.recording_mbid, m.claim_level, m.subject_slug, m.family_slug, i.name AS instrument_name, f.family_name, coalesce(i.nature, f.nature) AS sound_nature,
           m.scope, m.credit_count
    FROM o_mapped m LEFT JOIN (SELECT slug, name, nature FROM subject WHERE claim_level = 'instrument') i ON m.instrument_slug = i.slug
    JOIN (SELECT family_slug, min(family_name) AS family_name,
                 min(CASE family_slug WHEN 'synthesizers' THEN 'electronic' WHEN 'sampled-sounds' THEN 'sampled' ELSE 'acoustic' END) AS nature FROM subject GROUP BY 1) f ON m.family_slug = f.family_slug"""


@query("c13_claim_enrichment", _NAMES)
def enrichment(t: Tables) -> DataFrame:
    rows = mp.enrich_claims(mp.map_claims(_claims(t), t.taxonomy), t.taxonomy)
    return rows.select("recording_mbid", "claim_level", "subject_slug", "family_slug", "instrument_name", "family_name", "sound_nature", "scope", "credit_count")


@query("c14_vocabulary_enrichment", """
    SELECT v.artist_mbid, s.subject_slug AS instrument_slug, n.name AS instrument_name, s.family_slug, n.family_name, CAST(v.distinct_recordings AS BIGINT) AS distinct_recordings,
           v.prevalence, 1.0::DOUBLE AS evidence_quality, 'recording' AS source_scope
    FROM o_vocabulary v JOIN o_subject s USING (instrument_name) JOIN subject n ON n.slug = s.subject_slug AND n.claim_level = 'instrument'
    WHERE s.claim_level = 'instrument' AND v.artist_name <> 'Various Artists'""")
def vocabulary_enrichment(t: Tables) -> DataFrame:
    rows = mp.enrich_vocabulary(mp.map_vocabulary(_served_vocabulary(t), t.taxonomy), t.taxonomy)
    return rows.select("artist_mbid", "instrument_slug", "instrument_name", "family_slug", "family_name", "distinct_recordings", "prevalence", "evidence_quality", "source_scope")


@query("d31_layers", f"""
    SELECT recording_mbid, subject_slug AS slug, coalesce(instrument_name, family_name) AS name, family_slug, family_name, sound_nature AS nature,
           'documented' AS confidence, 1.0::DOUBLE AS prominence, claim_level FROM ({_NAMES}) WHERE scope = 'recording'""")
def layers(t: Tables) -> DataFrame:
    claims = mp.direct_only(mp.map_claims(_claims(t), t.taxonomy))
    return mp.assemble_layers(mp.enrich_claims(claims, t.taxonomy))


@query("b09_claim_consistency", """
    SELECT p_type AS claim_level, p_brand AS subject_slug,
           CASE WHEN p_type = 'instrument' THEN coalesce(i = s, false) WHEN p_type = 'family' THEN i IS NULL AND s = f ELSE false END AS consistent, CAST(count(*) AS BIGINT) AS claims
    FROM (SELECT p_brand, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'instrument' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'family' ELSE 'other' END AS p_type,
                 replace(lower(p_brand), '#', '-') AS s, CASE WHEN p_size > 30 THEN NULL WHEN p_size > 15 THEN 'brand-1' ELSE replace(lower(p_brand), '#', '-') END AS i,
                 CASE WHEN p_retailprice > 950 THEN replace(lower(p_brand), '#', '-') ELSE 'strings' END AS f FROM part) GROUP BY ALL""")
def consistency(t: Tables) -> DataFrame:
    slug = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    rows = t.table("part").select(
        F.when(F.col("p_type").isin("PROMO", "LARGE"), "instrument").when(F.col("p_type").isin("SMALL", "MEDIUM"), "family").otherwise("other").alias("claim_level"),
        F.col("p_brand").alias("subject_slug"), slug.alias("s"),
        F.when(F.col("p_size") > 30, F.lit(None).cast("string")).when(F.col("p_size") > 15, "brand-1").otherwise(slug).alias("i"),
        F.when(F.col("p_retailprice") > 950, slug).otherwise("strings").alias("f"),
    )
    ok = mp.consistent_claim(F.col("claim_level"), F.col("s"), F.col("i"), F.col("f"))
    return rows.groupBy("claim_level", "subject_slug", ok.alias("consistent")).agg(F.count(F.lit(1)).alias("claims"))
