import pytest
from pyspark.sql import functions as F

from creditloom.operators import evidence as ev
from creditloom.operators import mapping as mp
from creditloom.operators import serving as sv
from creditloom.schemas import ALIAS, EVIDENCE, VOCABULARY
from creditloom.sources.taxonomy import load_taxonomy


def ident(n):
    return f"{n:08d}-1111-4111-8111-111111111111"


def tables(spark, **more):
    frame = spark.createDataFrame
    base = {
        "artist": frame([(1, ident(1), "Ana"), (2, ident(2), "Bo")], "id bigint, gid string, name string"),
        "instrument": frame([(1, ident(10), "Piano"), (2, ident(11), "Cello")], "id bigint, gid string, name string"),
        "link_type": frame([(1, "Instrument"), (2, "VOCAL"), (3, "producer"), (4, "programming")], "id bigint, name string"),
        "link": frame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 9)], "id bigint, link_type bigint"),
        "link_attribute_type": frame([(1, ident(10), "piano"), (2, ident(11), "cello"), (3, None, "guest")], "id bigint, gid string, name string"),
        "link_attribute": frame([(1, 1), (1, 2), (1, 1), (1, 3), (1, 77), (2, 3)], "link bigint, attribute_type bigint"),
        "link_attribute_credit": frame([(1, 1, "a"), (1, 1, "b"), (1, 2, None), (1, 2, "")], "link bigint, attribute_type bigint, credited_as string"),
        "l_artist_recording": frame([(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 9, 1), (5, 1, 1), (1, 1, 99), (6, 1, 1)], "link bigint, artist bigint, recording bigint"),
        "recording": frame([(1, ident(21), "R1"), (2, ident(22), "R2"), (3, ident(23), "R3")], "id bigint, gid string, title string"),
        "track": frame([(ident(31), 1, 5), (ident(32), 3, 5), (ident(33), 2, 8), (ident(34), 3, 8)], "gid string, recording bigint, medium bigint"),
    }
    return {**base, **more}


def with_release(spark):
    frame = spark.createDataFrame
    return tables(
        spark,
        l_artist_release=frame([(1, 2, 50), (3, 2, 51)], "link bigint, artist bigint, release bigint"),
        release=frame([(50, ident(50), "Album"), (51, ident(51), "Other")], "id bigint, gid string, title string"),
        medium=frame([(5, 50), (8, 51)], "id bigint, release bigint"),
    )


def test_link_relations(spark):
    got = {r["link"]: r for r in ev.link_relations(tables(spark)).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[1]["attributes"] == ["cello", "guest", "piano"] and got[1]["original_credit"] == "b"
    assert [i["instrument_mbid"] for i in got[1]["instruments"]] == [ident(10), ident(11)]
    assert got[2]["relation_type"] == "vocal" and got[2]["instruments"] == [] and got[5]["attributes"] == []


def test_direct_evidence(spark):
    t = tables(spark)
    got = ev.direct_evidence(t, ev.link_relations(t), "v").collect()
    seen = sorted((r["recording_mbid"], r["instrument_name"], r["performer"], r["production_method"], r["original_credit"]) for r in got if r["performer"])
    assert seen == [
        (ident(21), "Cello", "Ana", "performed", "b"), (ident(21), "Piano", "Ana", "performed", "b"), (ident(22), "voice", "Ana", "performed", "voice"),
    ]
    # The unknown artist stays with null names; an instrument relation without instrument gives nothing.
    orphan = [r for r in got if r["performer"] is None]
    assert [(r["instrument_name"], r["instrument_mbid"], r["production_method"], r["attributes"]) for r in orphan] == [("programming", None, "programmed", ["programming"])]


def test_vocabulary_counts_context_rows_as_documented(spark):
    t = tables(spark)
    got = ev.recurrence_vocabulary(ev.direct_evidence(t, ev.link_relations(t), "v"), "v").collect()
    assert {(r["instrument_name"], r["distinct_recordings"], r["documented_recordings"], r["prevalence"]) for r in got} == {("Piano", 1, 2, 0.5), ("Cello", 1, 2, 0.5)}


def test_release_context_and_aliases(spark):
    t = with_release(spark)
    relations = ev.link_relations(t)
    got = ev.release_context(t, relations, "v").collect()
    assert sorted((r["recording_mbid"], r["instrument_name"], r["scope"]) for r in got) == [
        (ident(n), name, "release") for n in (21, 23) for name in ("Cello", "Piano")
    ]
    # Track 34 stands on an uncredited release but its recording is relevant: the closed set keeps it.
    aliases = {r["track_mbid"]: r["recording_mbid"] for r in ev.track_aliases(t, relations, "v").collect()}
    assert aliases == {ident(31): ident(21), ident(32): ident(23), ident(33): ident(22), ident(34): ident(23)}


def test_evidence_does_not_depend_on_row_order(spark, rows):
    t = with_release(spark)
    turned = {k: df.orderBy(F.desc(df.columns[0])).repartition(3) for k, df in t.items()}
    one, two = ev.aggregate(t, "v"), ev.aggregate(turned, "v")
    for name in ("direct", "release", "aliases", "vocabulary"):
        assert rows(getattr(one, name)) == rows(getattr(two, name))


def evidence(spark, *given):
    base = dict(scope="recording", relation_type="instrument", production_method="performed", instrument_mbid=ident(10), instrument_name="Piano", attributes=[], snapshot_version="v")
    names = [part.split()[0] for part in EVIDENCE.split(", ")]
    return spark.createDataFrame([tuple({**base, **row}.get(n) for n in names) for row in given], EVIDENCE)


def test_serving_golden(spark):
    direct = evidence(
        spark, {"recording_mbid": ident(1), "artist_mbid": ident(5), "performer": "P", "source_url": "s1"},
        {"recording_mbid": ident(1), "artist_mbid": ident(5), "performer": "P", "instrument_mbid": None},
    )
    release = evidence(
        spark, {"recording_mbid": ident(2), "scope": "release", "source_url": "s1"}, {"recording_mbid": ident(2), "scope": "release", "source_url": "s2"}
    )
    aliases = spark.createDataFrame([(ident(7), ident(1), "", "v"), (ident(8), ident(99), "", "v")], ALIAS)
    vocabulary = spark.createDataFrame(
        [(ident(5), "P", ident(10), "Piano", 3, 4, 0.75, True, "v"), ("89ad4ac3-39f7-470e-963a-56509c546377", "x", ident(10), "Piano", 3, 4, 0.75, True, "v")], VOCABULARY
    )
    s = sv.serve(direct, release, aliases, vocabulary, "v")
    counters = sv.stage_counters(s).first().asDict()
    want = dict(
        recording_count=2, credit_count=2, claim_count=2, release_fallback_recordings=1, discarded_unresolved_instrument_rows=1,
        discarded_special_artist_rows=1, vocabulary_entries=1, qualifying_vocabulary_entries=1, alias_count=1, orphan_alias_count=1,
        discarded_invalid_evidence_rows=0, discarded_invalid_alias_rows=0, discarded_invalid_vocabulary_rows=0, input_evidence_rows=4,
    )
    assert counters == want
    doc = {r["key"]: r["value"] for r in sv.recording_documents(s.claims, sv.claim_sources(s.evidence)).collect()}[ident(2)]
    claim = doc["claims"][0]
    assert (claim["credit_count"], claim["performer_count"], claim["source_url"], claim["source_urls"]) == (1, 0, "s1", ["s1", "s2"])


def test_hundred_performers_make_one_claim(spark):
    given = [{"recording_mbid": ident(1), "artist_mbid": ident(100 + n)} for n in range(100)]
    judged = sv.judge_evidence(evidence(spark, *given, {"recording_mbid": ident(1), "scope": "release"}), "v")
    claims = sv.aggregate_claims(sv.dedupe_credits(sv.accepted(judged))).collect()
    assert sorted((r["scope"], r["credit_count"], r["performer_count"]) for r in claims) == [("recording", 100, 100), ("release", 1, 0)]
    kept = sv.prefer_direct(sv.accepted(judged))
    assert {r["scope"] for r in kept.select("scope").distinct().collect()} == {"recording"}


def test_reject_order(spark):
    given = [
        ({"recording_mbid": "bad", "instrument_mbid": None}, "invalid_evidence"),
        ({"recording_mbid": ident(1), "instrument_mbid": None, "instrument_name": " "}, "unresolved_instrument"),
        ({"recording_mbid": ident(1), "instrument_name": " "}, "invalid_evidence"),
        ({"recording_mbid": ident(1), "scope": "track"}, "invalid_evidence"),
        ({"recording_mbid": ident(1), "scope": "", "relation_type": " VOCAL ", "instrument_mbid": None, "snapshot_version": ""}, None),
    ]
    for row, reason in given:
        assert sv.judge_evidence(evidence(spark, row), "v").first()["reject_reason"] == reason
    with pytest.raises(Exception, match="snapshot mismatch"):
        sv.judge_evidence(evidence(spark, {"recording_mbid": ident(1), "snapshot_version": "w"}), "v").collect()


def test_attributes_are_trimmed_unique_and_sorted(spark):
    row = {"recording_mbid": ident(1), "attributes": [" solo", "", "guest ", "solo"]}
    assert sv.judge_evidence(evidence(spark, row), "v").first()["attributes"] == ["Piano", "guest", "solo"]


def test_conflicting_aliases_fail(spark):
    df = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "a"), ("u", "b")], "track_mbid string, recording_mbid string")
    assert [r["track_mbid"] for r in sv.alias_conflicts(df).collect()] == ["u"]
    with pytest.raises(Exception, match="claims track u"):
        sv.unique_aliases(df).collect()


CLAIMS = "recording_mbid string, instrument_mbid string, instrument_name string, scope string, credit_count bigint, performer_count bigint, source_url string"


def test_mapping_priority(spark):
    taxonomy = load_taxonomy(spark, [(ident(10), "cello")])
    claims = spark.createDataFrame(
        [("r", ident(10), "Piano", "recording", 2, 1, "b"), ("r", None, "CELLO!", "recording", 3, 2, "a"), ("r", None, "guitar", "recording", 1, 1, None),
         ("r", None, "bass", "recording", 5, 5, None), ("q", None, "kazoo", "recording", 4, 1, None), ("r", ident(11), "Cuíca", "release", 1, 1, None)], CLAIMS,
    )
    mapped = {(r["claim_level"], r["subject_slug"], r["scope"]): (r["credit_count"], r["performer_count"], r["source_url"]) for r in mp.map_claims(claims, taxonomy).collect()}
    assert mapped == {("instrument", "cello", "recording"): (5, 3, "a"), ("family", "plucked-strings", "recording"): (1, 1, None), ("instrument", "cuica", "release"): (1, 1, None)}
    totals = {r["recording_mbid"]: (r["credit_count"], r["mapped_credit_count"], r["discarded_credit_count"], r["status"]) for r in mp.recording_totals(claims, taxonomy).collect()}
    assert totals == {"r": (12, 7, 5, "complete"), "q": (4, 0, 4, "complete_empty")}


def test_artists_map_to_instruments_only(spark):
    rows = spark.createDataFrame(
        [("a", None, "guitar", 3, 4, 0.5, True), ("a", None, "drum kit", 3, 4, 0.5, False), ("a", None, "drums (drum set)", 2, 4, 0.7, True)],
        "artist_mbid string, instrument_mbid string, instrument_name string, distinct_recordings bigint, documented_recordings bigint, prevalence double, qualifying boolean",
    )
    taxonomy = load_taxonomy(spark)
    assert [tuple(r) for r in mp.map_vocabulary(rows, taxonomy).collect()] == [("a", "drums", "percussion", 5, 8, 0.7, True)]
    assert [tuple(r) for r in mp.artist_totals(rows, taxonomy).collect()] == [("a", 3, 2, 1, "complete")]


def test_layers_take_one_per_subject(spark):
    taxonomy = load_taxonomy(spark)
    claims = spark.createDataFrame(
        [("r", "instrument", "piano", "piano", "acoustic-keys", "recording"), ("r", "instrument", "piano", "piano", "acoustic-keys", "track"),
         ("r", "family", "voice", None, "voice", "recording"), ("r", "family", "voice", "piano", "voice", "recording"), ("r", "instrument", "cello", "cello", "bowed-strings", "release")],
        "recording_mbid string, claim_level string, subject_slug string, instrument_slug string, family_slug string, scope string",
    )
    got = mp.assemble_layers(mp.enrich_claims(mp.direct_only(claims), taxonomy)).collect()
    assert sorted((r["slug"], r["name"], r["nature"], r["claim_level"]) for r in got) == [("piano", "Piano", "acoustic", "instrument"), ("voice", "Voz", "acoustic", "family")]


def test_taxonomy_is_consistent(spark):
    t = load_taxonomy(spark)
    assert t.families.count() == 10
    assert t.instruments.join(t.families, "family_slug", "left_anti").count() == 0
    assert t.instrument_aliases.join(t.instruments, "instrument_slug", "left_anti").count() == 0
    assert t.family_aliases.join(t.families, "family_slug", "left_anti").count() == 0
    names = mp.alias_dimension(t)
    assert names.count() == names.select("normalized_alias").distinct().count()
    assert names.where("normalized_alias = 'bass'").count() == 0


def test_dump_evidence_equals_judged_rows_with_direct_preferred(spark, rows):
    t = with_release(spark)
    frame = spark.createDataFrame
    t["recording"] = frame(
        [(1, "\t" + ident(21).upper() + " ", "R1"), (2, ident(22), "R2"), (3, ident(23), "R3"), (4, "no-id", "R4"), (5, ident(21), "R1 again"), (6, None, "R6")],
        "id bigint, gid string, title string",
    )
    t["artist"] = frame([(1, ident(1), "Ana"), (2, "no-id", " ")], "id bigint, gid string, name string")
    t["instrument"] = frame([(1, ident(10), " Piano "), (2, ident(11), "\t"), (3, "loose", "Oboe")], "id bigint, gid string, name string")
    t["link_attribute_type"] = frame(
        [(1, ident(10), " piano "), (2, ident(11), "cello"), (3, None, " "), (4, "loose", "oboe")], "id bigint, gid string, name string"
    )
    t["link_attribute"] = frame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (4, 4)], "link bigint, attribute_type bigint")
    # Recordings 3 to 6 have none but release credits, except 4 and 6, which have no id; 5 shares the id of 1.
    t["l_artist_recording"] = frame([(1, 1, 1), (2, 1, 2), (4, 9, 1), (1, 2, 4), (1, 1, 6)], "link bigint, artist bigint, recording bigint")
    t["l_artist_release"] = frame([(1, 2, 50), (2, 1, 50), (4, 1, 51), (3, 2, 51)], "link bigint, artist bigint, release bigint")
    t["track"] = frame([(ident(30 + n), n, m) for n in range(1, 7) for m in (5, 8)], "gid string, recording bigint, medium bigint")
    relations = ev.link_relations(t)
    both = sv.union_evidence(ev.direct_evidence(t, relations, "v").drop("recording", "artist"), ev.release_context(t, relations, "v"))
    expected = sv.prefer_direct(sv.accepted(sv.judge_evidence(both, "v")))
    got = sv.dump_evidence(t, relations)
    assert rows(got, *expected.columns) == rows(expected)
    assert {r["recording_mbid"] for r in got.where("scope = 'release'").collect()} == {ident(23)}


def test_claims_meet_order_lines_of_supported_relations_only(spark):
    from creditloom.plans import q_evidence
    from creditloom.plans.bridge import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lines = q_evidence._supported(t).view("line")
    assert lines.count() == t.view("line").where("type_id < 5").count()
    plan = q_evidence._claims(t)._jdf.queryExecution().optimizedPlan().toString()
    # Only the tracks of releases are read from the order lines themselves.
    assert plan.count("l_extendedprice") == 1
