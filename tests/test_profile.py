"""Scores against a plain re-computation and the published cases."""

import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators import families as fa
from creditloom.operators import listening as ls
from creditloom.operators import report as rp
from creditloom.operators import vocabulary as vo
from creditloom.schemas import HISTORY, LAYER, VOCABULARY_ROW


def layer(slug, family, nature="acoustic", prominence=1.0, level="instrument", confidence="documented"):
    return (slug, slug, family, family, nature, confidence, prominence, level)


def profiled(spark, tracks, listener="u"):
    """``tracks`` are (title, artist, plays, layers); each is its own recording."""
    history = [(listener, "overall", i + 1, t[0], t[1], t[2], f"r-{t[0]}", None, None, None) for i, t in enumerate(tracks)]
    layers = [(f"r-{t[0]}", *x) for t in tracks for x in dict.fromkeys(t[3])]
    h = ls.with_keys(spark.createDataFrame(history, HISTORY)).withColumn("recording_mbid", F.col("mbid"))
    return fa.profile_tracks(h, fa.recording_profiles(spark.createDataFrame(layers, LAYER)))


def report(spark, tracks):
    p = profiled(spark, tracks)
    c, f, b, d = fa.coverage(p), fa.family_presence(p), fa.sound_balance(p), fa.discovery(p)
    t = fa.temperament(p, f, b)
    return {
        "coverage": c.first(), "families": f.orderBy("family_rank").collect(), "balance": b.first(), "discovery": d.first(), "temperament": t.first(),
        "sections": fa.section_states(c, b, d, t).first(),
    }


GATES = [  # total, covered, coverage of tracks, of plays, artists, covered artists, ready
    (50, 10, 0.2, 0.2067, 20, 6, True), (50, 4, 0.08, 0.0646, 20, 3, False), (50, 2, 0.04, 0.0536, 20, 1, False), (200, 11, 0.055, 0.1506, 20, 4, True),
    (10, 5, 0.5, 0.5, 5, 3, True), (10, 5, 0.5, 0.04, 5, 3, False), (10, 5, 0.5, 0.5, 5, 1, False),
]


def test_gates(spark):
    df = spark.createDataFrame(
        [(i, *g[:6]) for i, g in enumerate(GATES)],
        "i int, total_tracks bigint, covered_tracks bigint, coverage_tracks double, coverage_plays double, total_artists bigint, covered_artists bigint",
    )
    got = {r["i"]: r["ready"] for r in fa.gate(df).collect()}
    assert got == {i: g[6] for i, g in enumerate(GATES)}


def test_family_counts_once_and_family_claims_give_no_nature(spark):
    layers = [layer("electric-guitar", "plucked-strings", "electric"), layer("electric-bass", "plucked-strings", "electric", 0.8), layer("drums", "percussion")]
    r = report(spark, [(f"t{i}", "a", 1, layers) for i in range(5)])
    assert r["coverage"]["status"] == "ready" and [f["share"] for f in r["families"]] == [0.5, 0.5]
    assert r["balance"]["balance_available"] and r["balance"]["unknown"] == 0.0
    bare = report(spark, [(f"t{i}", "a", 1, [layer("percussion", "percussion", None, 1.0, "family")]) for i in range(5)])
    assert bare["coverage"]["status"] == "ready" and not bare["balance"]["balance_available"]
    assert bare["sections"]["sound_balance"] == "insufficient_nature_evidence"


def test_vocal_presence(spark):
    voice, guitar = layer("voice", "voice", None, 1.0, "family"), layer("electric-guitar", "plucked-strings", "electric")
    c = report(spark, [(f"t{i}", f"artist-{i % 2}", i + 1, ([voice] if i < 3 else []) + [guitar]) for i in range(10)])["coverage"]
    assert (c["vocal_tracks"], c["vocal_artists"], c["vocal_plays"], c["vocal_track_ratio"], c["vocal_play_ratio"]) == (3, 2, 6, 0.3, 0.1091)


def test_discovery(spark):
    piano, cuica = layer("piano", "acoustic-keys"), layer("cuica", "percussion")
    r = report(spark, [(f"t{i}", f"a{i % 4}", 2, [piano] + ([cuica] if i < 3 else [])) for i in range(10)])
    assert r["discovery"]["instrument_slug"] == "cuica" and r["sections"]["discovery"] == "available"


@pytest.mark.parametrize(
    "layers, rule",
    [
        ([layer("drums", "percussion"), layer("synth", "synthesizers", "electronic"), layer("guitar", "plucked-strings", "electric")], "recurring-percussion-synthesizers"),
        ([layer("piano", "keys"), layer("cello", "bowed-strings")], "dominant-acoustic"),
        ([layer("a", "family-a", "electric"), layer("b", "family-b", "electric")], "dominant-electric"),
        ([layer("a", "family-a", "electronic"), layer("b", "family-b", "electronic")], "recurring-electronic"),
        ([layer("a", "family-a", "sampled"), layer("b", "family-b", "sampled")], "recurring-sampled"),
        ([layer("a", "family-a", "hybrid"), layer("b", "family-b", "hybrid")], "dominant-hybrid"),
    ],
)
def test_temperament(spark, layers, rule):
    r = report(spark, [(f"t{i}", f"a{i % 4}", 2, layers) for i in range(10)])
    assert r["temperament"]["rule"] == rule


def test_no_movement_without_shared_tracks(spark):
    tracks = [(f"t{i}", f"a{i % 4}", 1, [layer("drums", "percussion") if i < 5 else layer("synth", "synthesizers", "electronic")]) for i in range(10)]
    assert report(spark, tracks)["temperament"]["rule"] != "recurring-percussion-synthesizers"


WEIGHT = {"documented": 1.0, "strongly_associated": 0.75, "estimated": 0.45}


def brute_shares(tracks):
    scores, evidence = {}, {}
    for title, artist, plays, layers in tracks:
        best = {}
        for x in layers:
            key = (-x[6] * WEIGHT[x[5]], x[7] != "instrument", x[0])
            if x[2] not in best or key < best[x[2]][0]:
                best[x[2]] = (key, x[6] * WEIGHT[x[5]])
        total = sum(w for _, w in best.values())
        for family, (_, w) in best.items():
            scores[family] = scores.get(family, 0) + plays * w / total
            evidence.setdefault(family, set()).add((artist, title))
    whole = sum(scores.values())
    return {f: (round(s / whole, 3), len(evidence[f])) for f, s in scores.items()}


def test_shares_against_brute_force_in_any_order(spark):
    rng = random.Random(7)
    families = ["percussion", "brass", "voice", "synthesizers"]
    tracks = []
    for i in range(60):
        layers = [
            layer(f"s{rng.randrange(5)}", rng.choice(families), rng.choice(["acoustic", "electric", None]), rng.choice([1.0, 0.5]), rng.choice(["instrument", "family"]), rng.choice(list(WEIGHT)))
            for _ in range(rng.randrange(4))
        ]
        unique = list({x[0]: x for x in layers}.values())
        tracks.append((f"t{i}", f"a{rng.randrange(6)}", rng.randrange(1, 30), unique))
    for given in (tracks, tracks[::-1]):
        got = {r["family_slug"]: (round(r["share"], 3), r["evidence_count"]) for r in report(spark, given)["families"]}
        assert got == brute_shares(tracks)


def test_pairs_against_brute_force(spark):
    tracks = [("a", "x", 3, [layer("p", "percussion"), layer("b", "brass"), layer("v", "voice")]), ("b", "x", 5, [layer("p", "percussion"), layer("b", "brass")]), ("c", "y", 2, [layer("b", "brass")])]
    got = {(r["first_family"], r["second_family"]): (r["shared_tracks"], r["pair_share"]) for r in fa.family_pairs(profiled(spark, tracks)).collect()}
    assert got == {("brass", "percussion"): (2, 0.8), ("brass", "voice"): (1, 0.3), ("percussion", "voice"): (1, 0.3)}


def test_all_sections_from_one_row_of_sums(spark):
    kinds = [layer("piano", "keys"), layer("cuica", "percussion"), layer("moog", "synthesizers", "electronic"), layer("voice", "voice", None, 1.0, "family")]
    draw = random.Random(5)
    parts = []
    for who in ("u", "v", "w"):
        tracks = [(f"t{i}", f"a{draw.randrange(4)}", draw.randrange(1, 9), draw.sample(kinds, draw.randrange(5)) if who != "w" else []) for i in range(24)]
        parts.append(profiled(spark, [*tracks, *tracks[:3]], who))
    p = parts[0].unionByName(parts[1]).unionByName(parts[2])
    facts = fa.listener_facts(p)
    # Two dealings of the tracks to their listener; the groupings after them shuffle nothing.
    text = facts._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert text.count("REPARTITION_BY_COL") == 2 and "hashpartitioning(listener#" in text and "track_key" not in "".join(x for x in text.splitlines() if "ENSURE_REQUIREMENTS" in x)
    got = fa.TrackProfile.of(facts)
    presence, balance = fa.family_presence(p), fa.sound_balance(p)
    want = (fa.coverage(p), presence, balance, fa.discovery(p), fa.temperament(p, presence, balance))
    def rows(df):
        return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=str)

    for name, expected in zip(("covered", "presence", "balance", "found", "tempers"), want, strict=True):
        part = getattr(got, name)
        assert part.columns == expected.columns and rows(part) == rows(expected), name
    states = fa.section_states(got.covered, got.balance, got.found, got.tempers).select("listener", "families")
    assert rows(states) == rows(fa.families_state(got.covered).select("listener", "families"))


def test_rank_history_pages(spark):
    plays = spark.createDataFrame([("u", "overall", i // 2, f"m{i:03d}") for i in range(230)], "listener string, period string, play_count bigint, mbid string")
    got = ls.rank_history(plays, 200).orderBy("rank").collect()
    assert len(got) == 200 and got[0]["mbid"] == "m228" and [got[i]["page"] for i in (0, 49, 50, 199)] == [1, 1, 2, 4]
    plan = ls.rank_history(plays, 200)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_periods_count_back_from_a_day(spark):
    log = spark.createDataFrame([("u", "x", "2024-03-10"), ("u", "x", "2024-03-04"), ("u", "x", "2024-03-03"), ("u", "x", "2023-03-01"), ("u", "x", "2024-03-11")], "listener string, item string, d string")
    got = ls.plays_in_periods(log.withColumn("ts", F.to_timestamp("d")), F.to_date(F.lit("2024-03-10"))).collect()
    assert {r["period"]: r["play_count"] for r in got} == {"7day": 2, "1month": 3, "3month": 3, "6month": 3, "12month": 3, "overall": 4}


def vocabulary(spark, *given):
    return spark.createDataFrame([(a, s, s, f, f, n, 10, p, q, "recording") for a, s, f, n, p, q in given], VOCABULARY_ROW)


def history(spark, *given):
    return spark.createDataFrame([(l, "overall", i + 1, f"t{i}", name, plays, None, artist, None, None) for i, (l, name, plays, artist) in enumerate(given)], HISTORY)


def test_vocabulary_scores(spark):
    rows = vo.qualified(vocabulary(spark, ("a", "piano", "keys", 5, 0.5, 1.0), ("a", "organ", "keys", 3, 0.8, 0.5), ("a", "drums", "percussion", 2, 0.9, 1.0), ("b", "piano", "keys", 4, 0.25, 1.0)))
    h = history(spark, ("u", "A", 60, "A "), ("u", "B", 20, "b"), ("u", "C", 20, None), ("u", "c ", 0, None))
    plays = vo.artist_plays(h)
    r = vo.reach(plays, rows).first()
    assert (r["total_artists"], r["qualified_artists"], r["track_reach"], r["play_reach"], r["unresolved_artists"], r["unresolved_tracks"]) == (3, 2, 0.5, 0.8, 1, 2)
    scores = vo.contributions(plays, rows)
    # The weight of an artist is capped at 0.4; the best instrument brings its own quality.
    assert {(x["artist_mbid"], round(x["score"], 6)) for x in scores.collect()} == {("a", round(0.4 * 0.8 * 0.5, 6)), ("b", 0.05)}
    assert round(vo.concentration(scores).first()["concentration"], 6) == round(0.16 / 0.21, 6)
    f = vo.family_scores(scores, rows).first()
    assert (f["supporting_artists"], f["unique_instruments"], f["prevalence"], f["share"]) == (2, 2, 0.8, 1.0)


@pytest.mark.parametrize(
    "listens, qualified, pending, status, reason",
    [
        ([("A", 1, "a"), ("B", 1, "b"), ("C", 1, "c")], "abc", "", "available", "available"),
        ([("A", 1, "a"), ("B", 1, "b"), ("C", 1, "c"), ("D", 1, "d")], "abc", "d", "available", "available_with_pending_hydration"),
        ([("A", 1, "a"), ("B", 1, "b"), ("C", 1, "c")], "ab", "c", "pending", "snapshot_hydration_pending"),
        ([("A", 1, "a"), ("B", 1, "b"), ("C", 1, "c")], "ab", "", "insufficient", "insufficient_artist_diversity"),
        ([("A", 1, "a"), ("B", 1, "b"), ("C", 1, "c")], "", "ab", "insufficient", "no_mapped_evidence"),
        ([("A", 1, "a"), ("B", 1, "b"), ("C", 1, "c")], "", "abc", "pending", "snapshot_hydration_pending"),
        ([("A", 1, "a"), ("B", 99, "b")], "a", "", "insufficient", "insufficient_play_reach"),
        ([("A", 1, "a")] + [(f"N{i}", 1, None) for i in range(10)], "a", "", "insufficient", "insufficient_track_reach"),
        ([("A", 98, "a"), ("B", 1, "b"), ("C", 1, "c")], "abc", "", "insufficient", "excessive_artist_concentration"),
    ],
)
def test_vocabulary_gate(spark, listens, qualified, pending, status, reason):
    rows = vocabulary(spark, *[(ident(ord(a)), "piano", "keys", 3, 1.0, 1.0) for a in qualified])
    plays = vo.artist_plays(history(spark, *[("u", name, n, a and ident(ord(a))) for name, n, a in listens]))
    ended = [(ident(ord(a)), "complete") for _, _, a in listens if a and a not in pending]
    statuses = spark.createDataFrame(ended, "artist_mbid string, status string")
    got = vo.vocabulary_gate(plays, rows, statuses).first()
    assert (got["status"], got["reason"], got["pending_artists"]) == (status, reason, len(pending))


def ident(n):
    return f"{n:08d}-1111-4111-8111-111111111111"


def test_full_report(spark, tmp_path):
    h = [("u", "overall", i + 1, f"t{i}", f"A{i % 4}", 10 - i, ident(i) if i != 7 else None, ident(100 + i % 4), None, None) for i in range(9)]
    aliases = spark.createDataFrame([(ident(0), ident(50))], "track_mbid string, recording_mbid string")
    layers = [(ident(50 if i == 0 else i), *layer("piano", "acoustic-keys")) for i in range(6)]
    statuses = spark.createDataFrame([(ident(6), "complete_empty")], "recording_mbid string, status string")
    artists = spark.createDataFrame([(ident(100 + i), "complete") for i in range(3)], "artist_mbid string, status string")
    vocab = vocabulary(spark, *[(ident(100 + i), "piano", "acoustic-keys", 3, 1.0, 1.0) for i in range(4)])
    reports = rp.build_reports(spark.createDataFrame(h, HISTORY), rp.Evidence(aliases, spark.createDataFrame(layers, LAYER), statuses, artists, vocab), "v")
    r = rp.with_violations(reports).first()
    assert r["methodology_version"] and [i["instrument_slug"] for f in r["vocabulary_families"] for i in f["instruments"]] == ["piano"]
    assert r["violations"] == [] and r["tracks_analyzed"] == 9 and r["analysis"]["status"] == "ready"
    c = r["recording_status_counts"]
    assert (c["resolved"], c["unresolved_identity"], c["resolved_without_evidence"], c["pending_enrichment"]) == (6, 1, 1, 1)
    assert r["available_views"] == ["track_palette", "artist_vocabulary"] and r["default_view"] == "track_palette"
    assert (r["hydration"]["pending_recordings"], r["hydration"]["pending_aliases"], r["hydration"]["pending_artists"]) == (1, 1, 1)
    assert [f["name"] for f in r["featured_artists"]] == ["A0", "A1", "A2"] and len(r["recordings"]) == 9
    stored = rp.build_reports(spark.createDataFrame(h, HISTORY), rp.Evidence(aliases, spark.createDataFrame(layers, LAYER), statuses, artists, vocab), "v", path=str(tmp_path))
    assert stored.collect() == reports.collect()
    broken = reports.withColumn("period", F.lit("2day"))
    assert rp.with_violations(broken).first()["violations"] == ["period"]


def test_hydration_targets_are_unique_ordered_and_capped(spark):
    h = [("u", "overall", i + 1, f"t{i}", "A", 1, ident(i % 60), None, None, None, ident(i % 60), "pending_enrichment") for i in range(61)]
    tracks = spark.createDataFrame(h, HISTORY + ", recording_mbid string, recording_status string")
    statuses = spark.createDataFrame([(ident(1), "pending")], "recording_mbid string, status string")
    assert rp.hydration_targets(tracks, statuses).count() == 60
    got = rp.hydration_targets(tracks, statuses, 50).orderBy("position").collect()
    assert [r["target_mbid"] for r in got] == [ident(i) for i in range(50)]
    assert [r["kind"] for r in got[:3]] == ["track", "recording", "track"]


def test_two_spellings_of_a_name_are_one_family(spark):
    rows = [(ident(i), "piano", "Piano" if i % 2 else "A Piano", "keys", "Keys" if i % 2 else "Clavier", "acoustic", "instrument", "documented", 1.0) for i in range(4)]
    layers = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[7], r[8], r[6]) for r in rows], LAYER)
    h = [("u", "overall", i + 1, f"t{i}", f"A{i}", 10, ident(i), None, None, None) for i in range(4)]
    tracks = ls.with_keys(spark.createDataFrame(h, HISTORY)).withColumn("recording_mbid", F.col("mbid"))
    got = fa.family_presence(fa.profile_tracks(tracks, fa.recording_profiles(layers)), fa.Names.of(layers)).collect()
    assert [(r["family_slug"], r["family_name"], r["evidence_count"], r["share"]) for r in got] == [("keys", "Clavier", 4, 1.0)]


def test_family_scores_shuffle_no_exploded_rows(spark):
    rows = spark.createDataFrame([("m", "piano", "Piano", "keys", "Keys", 9, 9, 1.0, 1.0, "recording")], "artist_mbid string, instrument_slug string, instrument_name string, family_slug string, family_name string, distinct_recordings bigint, documented_recordings bigint, prevalence double, evidence_quality double, source_scope string")
    plays = vo.artist_plays(spark.createDataFrame([("u", "overall", "M", "m", 3)], "listener string, period string, artist string, artist_mbid string, play_count bigint"))
    scores = vo.family_scores(vo.contributions(plays, rows), rows)
    assert [(r["family_slug"], r["share"], [i["instrument_slug"] for i in r["instruments"]]) for r in scores.collect()] == [("keys", 1.0, ["piano"])]
    plan = scores._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert dealt and not any("instrument_slug" in x or "artist_id" in x for x in dealt)
