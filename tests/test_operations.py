"""Jobs, admission, snapshots, streams, catalog and editorial rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from creditloom.config import SERVING_SCHEMA, Policy
from creditloom.operators import admission as ad
from creditloom.operators import catalog as ca
from creditloom.operators import hydration as hy
from creditloom.operators import quality as qu
from creditloom.operators import snapshots as sn
from creditloom.operators import studies as st
from creditloom.operators import tables as tb
from creditloom.schemas import JOB, SNAPSHOT
from creditloom.session import cut_lineage
from creditloom.sources.taxonomy import load_taxonomy
from creditloom.streaming import admission as st_admission
from creditloom.streaming import usage as us

NOW = datetime(2024, 1, 10, 12)


def ident(n):
    return f"{n:08d}-1111-4111-8111-111111111111"


def job(i, status="pending", attempts=0, due=None, updated=NOW, kind="recording", version="v", created=NOW):
    return (i, version, kind, ident(i), "0000", status, attempts, None, due, created, updated)


def jobs(spark, *given):
    return spark.createDataFrame(list(given), JOB)


def now():
    return F.lit(NOW)


def test_eligible_jobs(spark):
    ago, later = NOW - timedelta(minutes=11), NOW + timedelta(minutes=1)
    df = jobs(
        spark, job(1), job(2, "failed", 4, NOW), job(3, "failed", 5), job(4, "pending", 0, later), job(5, "processing", 5, None, ago), job(6, "processing", 1), job(7, "complete"), job(8, version="w"),
    )
    active = spark.createDataFrame([("v",)], "snapshot_version string")
    got = hy.eligible_jobs(df, active, now())
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 5]
    taken = {r["id"]: (r["status"], r["attempts"]) for r in hy.claim_jobs(got, now()).collect()}
    assert taken == {1: ("processing", 1), 2: ("processing", 5), 5: ("processing", 5)}
    assert [r["id"] for r in hy.oldest_jobs(got, 2).orderBy("position").collect()] == [1, 2]


def test_failures_and_deferral(spark):
    df = jobs(spark, job(1, "processing", 1), job(2, "processing", 5), job(3, "processing", 3, kind="artist"))
    got = {r["id"]: r for r in hy.fail_jobs(df, now(), F.lit("x" * 900), F.col("target_kind") == "artist").collect()}
    assert got[1]["next_attempt_at"] == NOW + timedelta(seconds=60) and not got[1]["terminal"] and len(got[1]["last_error"]) == 900
    assert got[2]["terminal"] and got[2]["next_attempt_at"] is None and got[3]["terminal"] and got[3]["attempts"] == 5
    back = {r["id"]: (r["status"], r["attempts"], r["next_attempt_at"]) for r in hy.defer_jobs(df, now(), "budget").collect()}
    assert back[1] == ("pending", 0, NOW + timedelta(minutes=2))


def test_materialize_and_commit_are_idempotent(spark, rows):
    claims = spark.createDataFrame([(ident(1), None, "Piano", "recording", 2, 1, "s")], "recording_mbid string, instrument_mbid string, instrument_name string, scope string, credit_count bigint, performer_count bigint, source_url string")
    vocab = spark.createDataFrame([(ident(3), None, "Piano", 3, 4, 0.75, True)], "artist_mbid string, instrument_mbid string, instrument_name string, distinct_recordings bigint, documented_recordings bigint, prevalence double, qualifying boolean")
    served = hy.Servings(spark.createDataFrame([(ident(4), ident(1))], "track_mbid string, recording_mbid string"), claims, vocab)
    df = jobs(spark, job(1), job(2), job(3, kind="artist"), job(4, kind="track"), job(5, kind="track"))
    new = hy.materialize(df, served, load_taxonomy(spark), now())
    assert rows(new.recordings, "recording_mbid", "status", "credit_count") == [(ident(1), "complete", 2), (ident(2), "complete_empty", 0)]
    assert rows(new.recording_claims, "recording_mbid", "subject_slug") == [(ident(1), "piano")]
    assert rows(new.artists, "artist_mbid", "status", "entry_count") == [(ident(3), "complete", 1)]
    assert rows(new.aliases, "track_mbid", "recording_mbid") == [(ident(4), ident(1))]
    empty = hy.Projections(*[f.limit(0) for f in (new.aliases, new.recordings, new.recording_claims, new.artists, new.artist_instruments)], df)
    once = hy.commit(empty, df, new, now())
    twice = hy.commit(once, df, new, now())
    for name in ("aliases", "recordings", "recording_claims", "artists", "artist_instruments", "jobs"):
        assert rows(getattr(once, name)) == rows(getattr(twice, name))
    # The track without alias asks for itself as a recording; recording 1 was queued already.
    assert rows(once.jobs.where("target_kind = 'recording' and status = 'pending'"), "target_mbid") == [(ident(5),)]
    assert once.jobs.where("status = 'complete'").count() == 5


def test_upsert(spark, rows):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, made int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30)], "k int, v string, made int")
    once = tb.upsert(old, new, ["k"], keep=("made",))
    assert rows(once) == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]
    assert rows(tb.upsert(once, new, ["k"], keep=("made",))) == rows(once)
    assert rows(tb.insert_new(old, new, ["k"])) == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]


def brute_admission(requests, queued, backlog, used, policy):
    """One request after the other, whole or not at all."""
    first = {}
    for r, ts, _, _ in requests:
        first[r] = min(first.get(r, ts), ts)
    queued, used, calls, out = set(queued), dict(used), {}, {}
    for ts, r in sorted((ts, r) for r, ts in first.items()):
        day = ts.strftime("%Y-%m-%d")
        targets = {(k, m) for q, _, k, m in requests if q == r}
        if any(k not in ("track", "recording", "artist") or len(m or "") != 36 for k, m in targets):
            out[r] = (False, "invalid_request", 0, None, None, None)
            continue
        calls[day] = calls.get(day, 0) + 1
        if calls[day] > policy.daily_calls:
            out[r] = (False, "hydration_daily_budget", 0, None, None, None)
            continue
        cost = sum(2 if k == "track" else 1 for k, _ in targets - queued)
        today = used.get(day, 0)
        fits_day = today + cost <= policy.daily_new_units
        taken = cost == 0 or fits_day and backlog + cost <= policy.max_pending_units
        out[r] = (taken, None if taken else "hydration_busy" if fits_day else "hydration_daily_budget", len(targets) if taken else 0, cost, backlog, today)
        if taken:
            queued |= targets
            backlog += cost
            used[day] = today + cost
    return out


REQUESTS = "request_id string, ts timestamp, kind string, target_mbid string"


def answers(decisions):
    return {r.request_id: (r.admitted, r.code, r.accepted, r.fresh_units, r.backlog_units, r.used_units) for r in decisions.collect()}


@pytest.mark.parametrize(("seed", "limits"), [(1, (40, 9, 8)), (2, (30, 14, 100)), (3, (1000, 6, 9))])
def test_admission_against_brute_force(spark, seed, limits):
    rng = random.Random(seed)
    requests = []
    for n in range(48):
        ts = NOW + timedelta(hours=n, seconds=rng.randrange(2))
        for _ in range(rng.randrange(1, 5)):
            requests.append((f"r{n:02d}", ts, rng.choice(["track", "recording", "artist"]), ident(rng.randrange(14)) if rng.random() > 0.02 else "bad"))
        requests.append(requests[-1])
    policy = Policy(max_pending_units=limits[0], daily_new_units=limits[1], daily_calls=limits[2])
    queue = jobs(spark, job(1, created=NOW - timedelta(days=1)), job(2, "complete", created=NOW), job(3, "failed", 5, created=NOW + timedelta(days=1), kind="track"))
    want = brute_admission(requests, {("recording", ident(1)), ("recording", ident(2)), ("track", ident(3))}, 1, {"2024-01-09": 1, "2024-01-10": 1, "2024-01-11": 2}, policy)
    got = ad.decide(spark.createDataFrame(requests, REQUESTS), queue, policy)
    assert answers(got) == want and len({v[:2] for v in want.values()}) >= 3
    for row in got.collect():
        assert (row.retry_after is None) == (row.code in (None, "invalid_request")) and (row.code != "hydration_busy" or row.retry_after == 120)


@pytest.mark.parametrize("stretch", [1, 100_000])
def test_admission_walks_only_days_that_bring_something(spark, monkeypatch, stretch):
    """Sixty days of which the backlog is filled on the first ones: few checkpoints, however many days."""
    cuts = []
    monkeypatch.setattr(ad, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    rng = random.Random(5)
    requests = [(f"r{n:03d}", NOW + timedelta(hours=n * 8), rng.choice(["track", "recording"]), ident(rng.randrange(60))) for n in range(180)]
    policy = Policy(max_pending_units=12, daily_new_units=3, daily_calls=3)
    got = ad.decide(spark.createDataFrame(requests, REQUESTS), jobs(spark, job(1)), policy, stretch_rows=stretch)
    assert answers(got) == brute_admission(requests, {("recording", ident(1))}, 1, {"2024-01-10": 1}, policy)
    assert len(cuts) <= (5 if stretch > 1 else 15)


def test_admission_of_nothing(spark):
    assert ad.decide(spark.createDataFrame([], REQUESTS), jobs(spark, job(1))).count() == 0
    assert answers(ad.decide(spark.createDataFrame([("a", NOW, "track", None), ("b", NOW, None, ident(1))], REQUESTS), jobs(spark, job(9)).limit(0))) == {"a": (False, "invalid_request", 0, None, None, None), "b": (False, "invalid_request", 0, None, None, None)}


def test_admission_stream(spark, tmp_path):
    source, table = tmp_path / "requests", str(tmp_path / "jobs")
    jobs(spark, job(1, created=NOW)).write.parquet(table)
    given = [("a", NOW, "track", ident(2)), ("a", NOW, "track", ident(2)), ("b", NOW, "recording", "bad"), ("b", NOW, "recording", ident(3)), ("c", NOW, "recording", ident(1)), ("d", NOW + timedelta(1), "artist", ident(4))]
    spark.createDataFrame(given, REQUESTS).coalesce(1).write.parquet(str(source))
    appended, told = [], []

    def append(new, batch_id):
        appended.append(batch_id)
        new.write.mode("append").parquet(table)

    def run(ttl_ms):
        st_admission.start_admission(
            spark.readStream.schema(REQUESTS).parquet(str(source)), lambda s: s.read.schema(JOB).parquet(table), append, "v", str(tmp_path / "cp"), ttl_ms=ttl_ms, once=True,
            answer=lambda decisions, _: told.append({r.request_id: r.code for r in decisions.collect()}),
        ).awaitTermination()

    run(3_600_000)
    got = {(r["target_kind"], r["target_mbid"], r["shard_key"]) for r in spark.read.parquet(table).where("id <> 1").collect()}
    assert got == {("track", ident(2), "0000"), ("artist", ident(4), "000")}
    assert len(appended) == len(set(appended))  # two days, one append
    assert told == [{"a": None, "b": "invalid_request", "c": None, "d": None}]
    # The state outlives the query: repeats are dropped, and what a request adds passes.
    spark.createDataFrame([*given, ("a", NOW, "recording", ident(7))], REQUESTS).coalesce(1).write.mode("append").parquet(str(source))
    run(3_600_000)
    assert told[1:] == [{"a": None}]
    assert spark.read.parquet(table).where(F.col("target_mbid") == ident(7)).count() == 1


def test_budget_ledger_is_a_running_sum(spark):
    rng = random.Random(3)
    given = [(i, NOW + timedelta(minutes=rng.randrange(3000)), rng.randrange(9)) for i in range(200)]
    got = hy.budget_ledger(spark.createDataFrame(given, "event_id bigint, ts timestamp, units bigint"), F.date_format("ts", "yyyy-MM-dd"), 150).collect()
    total = {}
    want = {}
    for i, ts, n in sorted(given, key=lambda g: (g[1], g[0])):
        day = ts.strftime("%Y-%m-%d")
        total[day] = total.get(day, 0) + n
        want[i] = (total[day], total[day] <= 150)
    assert {r["event_id"]: (r["charged"], r["admitted"]) for r in got} == want


def test_usage_and_top_track_streams(spark, tmp_path):
    schema = "listener string, item string, ts timestamp, units bigint"
    given = [("u", "x", NOW, 5), ("u", "y", NOW, 6), ("u", "x", NOW + timedelta(hours=1), 7), ("w", "z", NOW + timedelta(days=30), 1)]
    spark.createDataFrame(given, schema).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    query = us.daily_usage(log).writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    query.awaitTermination()
    got = us.over_limit(spark.table("usage"), 10).collect()
    assert {r["day"]: (r["units"], r["within_limit"]) for r in got} == {"2024-01-10": (18, False), "2024-02-09": (1, True)}
    query = us.start_top_tracks(log, "item", str(tmp_path / "out"), str(tmp_path / "cp2"), once=True)
    query.awaitTermination()
    top = spark.read.parquet(str(tmp_path / "out")).where("period = '2024-01-11' and rank = 1").collect()
    assert [(r["listener"], r["item"], r["play_count"]) for r in top] == [("u", "x", 2)]


def snapshot(version, status, published, created=NOW):
    return (version, SERVING_SCHEMA, "0" * 64, 1, 1, status, "unix:0", published, created, "p", "m")


def test_snapshots(spark):
    df = spark.createDataFrame([snapshot("a", "active", NOW), snapshot("b", "active", NOW + timedelta(1)), snapshot("c", "staging", None)], SNAPSHOT)
    assert sn.active_snapshot(df).first()["snapshot_version"] == "b" and sn.active_snapshot(df, "c").first()["status"] == "staging"
    assert sn.active_snapshot(df, "zz").count() == 0 and sn.more_than_one_active(df).count() == 1
    manifest = spark.createDataFrame(
        [(SERVING_SCHEMA, "d", "https://e.org", "CC0", "x", "unix:1", "p", "AB" * 32, 5, 6)],
        "schema_version string, snapshot_version string, source_url string, license string, attribution string, generated_at string, object_prefix string, manifest_hash string, recording_count bigint, credit_count bigint",
    )
    out = sn.publish(df, manifest, NOW)
    assert {r["snapshot_version"]: r["status"] for r in out.collect()} == {"a": "superseded", "b": "superseded", "c": "staging", "d": "active"}
    assert sn.more_than_one_active(out).count() == 0
    with pytest.raises(Exception, match="not publishable"):
        sn.publish(df, manifest.withColumn("manifest_hash", F.lit("x")), NOW).collect()
    batches = spark.createDataFrame([("u", "a"), ("u", "b"), ("w", "a")], "k string, snapshot_version string")
    assert [r["k"] for r in sn.mixed_snapshots(batches, ["k"]).collect()] == ["u"]
    with pytest.raises(Exception, match="pinned snapshot changed"):
        sn.pin(batches, ["k"]).collect()


def test_nearest_rank_against_brute_force(spark):
    rng = random.Random(5)
    given = [(g, rng.choice([rng.random() * 40, float(rng.randrange(5))])) for g in "ab" for _ in range(rng.randrange(50, 150))]
    got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in st.nearest_rank(spark.createDataFrame(given, "g string, v double"), "g", "v").collect()}
    import math

    for g in "ab":
        values = sorted(v for k, v in given if k == g)
        assert got[g] == tuple(values[max(0, math.ceil(len(values) * p) - 1)] for p in (0.5, 0.95, 0.99))


def test_example_sample(spark):
    given = [("s", f"r{i:02d}", f"a{i % 9}", i % 2 == 0) for i in range(60)] + [("tiny", "x", "a0", True)]
    df = spark.createDataFrame(given, "sample_id string, recording_mbid string, artist_id string, direct boolean")
    priority = spark.createDataFrame([("a1",), ("a2",)], "artist_id string")
    one = st.example_sample(df, priority, "seed", "7day").collect()
    again = st.example_sample(df.repartition(5), priority, "seed", "7day").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, again))
    picked = [r for r in one if r["sample_id"] == "s"]
    assert len(picked) == 15 and sum(not r["direct"] for r in picked) == 3 and len([r for r in one if r["sample_id"] == "tiny"]) == 1
    per_artist = {a: sum(r["artist_id"] == a for r in picked) for a in {r["artist_id"] for r in picked}}
    assert max(per_artist.values()) <= 3 and {"a1", "a2"} <= per_artist.keys() and len(per_artist) == 9
    assert all(r["play_count"] == 12 for r in picked if r["artist_id"] in ("a1", "a2"))
    other = st.example_sample(df, priority, "other", "7day").collect()
    assert sorted(map(tuple, one)) != sorted(map(tuple, other))


def brute_sample(given, priority, seed, target=15, per_artist=3):
    """The fillings one after the other, on lists."""
    import hashlib

    out = set()
    for sample in {g[0] for g in given}:
        rows = {}
        for s, r, a, d in given:
            if s == sample:
                old = rows.get(r)
                rows[r] = (min(a, old[0]), d or old[1]) if old else (a, d)
        key = lambda r: (not rows[r][1], hashlib.md5(f"{seed}:{r}".encode()).hexdigest(), r)
        taken = []
        for artist in priority:
            mine = sorted((r for r in rows if rows[r][0] == artist), key=key)
            taken += mine[:1]

        def fill(pool, room, rows=rows, key=key, taken=taken):
            held = {a: sum(rows[r][0] == a for r in taken) for a in {v[0] for v in rows.values()}}
            ranked, seen = [], {}
            for r in sorted((r for r in rows if pool(rows[r]) and r not in taken), key=key):
                a = rows[r][0]
                seen[a] = seen.get(a, 0) + 1
                if seen[a] + held[a] <= per_artist:
                    ranked.append((seen[a] + held[a] > 1, *key(r)))
            taken += [x[-1] for x in sorted(ranked)[: max(0, room)]]

        fill(lambda v: v[1], target - min(sum(not v[1] for v in rows.values()), target // 3))
        fill(lambda v: not v[1], target - len(taken))
        fill(lambda v: True, target - len(taken))
        out |= {(sample, r) for r in taken}
    return out


@pytest.mark.parametrize(("artists", "direct", "preferred"), [(400, 0.5, 3), (3, 0.5, 1), (12, 0.05, 2), (12, 0.95, 0), (60, 0.2, 30)])
def test_example_sample_against_brute_force(spark, artists, direct, preferred):
    rng = random.Random(artists)
    given = [(rng.choice("st"), f"r{rng.randrange(900):03d}", f"a{rng.randrange(artists):03d}", rng.random() < direct) for _ in range(900)]
    priority = [f"a{i:03d}" for i in range(preferred)]
    df = spark.createDataFrame(given, "sample_id string, recording_mbid string, artist_id string, direct boolean")
    got = st.example_sample(df, spark.createDataFrame([(a,) for a in priority], "artist_id string"), "seed").collect()
    assert {(r.sample_id, r.recording_mbid) for r in got} == brute_sample(given, priority, "seed") and len(got) == len({(r.sample_id, r.recording_mbid) for r in got})


def test_assets_and_slugs(spark):
    variants = "array<struct<name: string, url: string>>"
    images = spark.createDataFrame(
        [("ok", "approved", None, None, [("thumb", "t"), ("detail", "d")]), ("draft", "draft", "u", None, []), ("hash", "published", "u", None, [("detail", "x<hash>.png")]), ("plain", "published", None, "out", [])],
        f"asset_id string, status string, url string, output string, variants {variants}",
    )
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} string, asset_id string")
    subjects = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f"), ("e", "g")], "slug string, family_slug string")
    got = ca.resolve_assets(subjects, frame([("a", "ok"), ("b", "draft"), ("c", "hash")], "slug"), frame([("b", "plain")], "slug"), frame([("f", "ok")], "family_slug"), images)
    assert {r["slug"]: (r["asset_id"], r["asset_url"], r["resolution"]) for r in got.collect()} == {
        "a": ("ok", "d", "exact"), "b": ("plain", "out", "related"), "c": ("ok", "d", "family"), "e": (None, None, None),
    }
    slugs = spark.createDataFrame([("bateria",), ("percussao",), ("piano",), ("voice",), ("kazoo",)], "slug string")
    assert {r["slug"]: (r["canonical_slug"], r["kind"]) for r in ca.resolve_slugs(slugs, load_taxonomy(spark)).collect()} == {
        "bateria": ("drums", "instrument"), "percussao": ("percussion", "family"), "piano": ("piano", "instrument"), "voice": ("voice", "family"), "kazoo": ("kazoo", None),
    }


def sheet(slug="piano", locale="pt-BR", status="published", text="A fact.", revision=None, verified=True, url="https://e.org", reviewer="r"):
    review = (True, reviewer, "2024-01-01")
    return (
        "instrument", slug, "keys", "Piano", "d", "s", ["melody"], [(f"b-{slug}", "curiosity", text, "editorial_summary", "published", [("s1", None, None)], review)],
        [("s1", "Title", ["W"], None, url, "2024-01-01", "book", verified, "2024-01-02")], [("More", "https://e.org/m", None, "draft", None, None)], ("a", "alt", "cap"), (["s1"], []), review,
        locale, status, revision,
    )


def sheets(spark, *given):
    return spark.createDataFrame(list(given), qu.SHEET)


def test_sheet_rules(spark):
    assert qu.sheet_violations(sheets(spark, sheet())).count() == 0
    bad = sheets(spark, sheet(verified=False, url="ftp://x"), sheet("Two", text=" ", reviewer=None), sheet("three", verified=True))
    got = {(r["slug"], r["violation"]) for r in qu.sheet_violations(bad).collect()}
    assert {("piano", "source_url"), ("piano", "source_unverified"), ("piano", "source_conflict"), ("three", "source_conflict"), ("Two", "slug"), ("Two", "block_fields"), ("Two", "review_identity"), ("Two", "block_review_identity")} <= got
    assert not {v for s, v in got if s == "three"} - {"source_conflict"}


def test_staleness_and_withdrawal(spark):
    base = sheets(spark, sheet())
    digest = base.select(qu.source_revision(base)).first()[0]
    legacy = base.select(qu.source_revision(base, legacy=True)).first()[0]
    other = [sheet(locale="en-US", revision=digest), sheet(locale="es-ES", revision=legacy), sheet(locale="fr-FR", revision="0" * 64), sheet(locale="de-DE", revision="0" * 64, status="deprecated")]
    got = {r["locale"]: (r["status"], r["source_revision"] == digest) for r in qu.revised(sheets(spark, sheet(), *other)).collect()}
    assert got == {"pt-BR": ("published", True), "en-US": ("published", True), "es-ES": ("published", True), "fr-FR": ("stale", False), "de-DE": ("deprecated", False)}
    # A reviewer's name is no part of the content; the text is.
    same, changed = sheets(spark, sheet(reviewer="someone else")), sheets(spark, sheet(text="Another fact."))
    assert same.select(qu.source_revision(same)).first()[0] == digest != changed.select(qu.source_revision(changed)).first()[0]
    after = qu.carry_withdrawn(sheets(spark, sheet(), sheet("cello")), sheets(spark, sheet()))
    assert {r["slug"]: r["status"] for r in after.collect()} == {"piano": "published", "cello": "deprecated"}
    assert {r["slug"]: r["status"] for r in qu.carry_withdrawn(after, sheets(spark, sheet())).collect()}["cello"] == "deprecated"


def test_split_and_expand_round_trip(spark, rows):
    given = sheets(spark, sheet(), sheet("cello"), sheet(locale="en-US", text="Translated.", revision="1" * 64))
    parts = qu.split_sheets(given)
    assert rows(qu.expand_sheets(parts).select(*given.columns)) == rows(given)
    assert qu.snapshot_faults(parts).count() == 0
    parts["sources"] = parts["sources"].limit(0)
    assert {r["fault"] for r in qu.snapshot_faults(parts).collect()} == {"unknown_source"}


def test_unlisted_blocks_are_deprecated(spark, rows):
    blocks = spark.createDataFrame([("b1", "piano", "curiosity", "published", True), ("b2", "piano", "curiosity", "published", True), ("b3", "cello", "curiosity", "published", True)], "block_id string, subject_slug string, section_kind string, status string, claim_support_verified boolean")
    out = qu.deprecate_unlisted(blocks, blocks.where("block_id = 'b1'"), blocks.where("subject_slug = 'piano'"))
    assert rows(out, "block_id", "status", "claim_support_verified") == [("b1", "published", True), ("b2", "deprecated", False), ("b3", "published", True)]


def test_translation_needs_current_source_and_image(spark):
    pubs = spark.createDataFrame([("p", "active", 2), ("old", "superseded", 2)], "revision string, status string, content_schema_version int")
    schema = "resource_type string, resource_slug string, locale string, source_revision string, content_revision string, publication_revision string, status string, reviewer string, reviewed_at string, asset_id string"
    row = lambda slug, locale, rev, status="published", asset="i", pub="p": ("instrument", slug, locale, rev, f"{slug}-{locale}", pub, status, "r", "t", asset)
    texts = spark.createDataFrame(
        [row("a", "pt-BR", "1"), row("a", "en-US", "1"), row("b", "pt-BR", "1"), row("b", "en-US", "0"), row("c", "pt-BR", "1", "draft"), row("c", "en-US", "1"), row("d", "pt-BR", "1"), row("d", "en-US", "1", asset="j"), row("e", "pt-BR", "1", pub="old")], schema,
    )
    asks = spark.createDataFrame([("instrument", s, "en-US", "i") for s in "abcde"], "resource_type string, resource_slug string, requested_locale string, asset_id string")
    got = {r["resource_slug"]: (r["withheld"], r["locale"]) for r in ca.select_translations(asks, pubs, texts).collect()}
    assert got == {"a": (False, "en-US"), "b": (False, "pt-BR"), "c": (True, None), "d": (False, "pt-BR"), "e": (True, None)}


def test_all_rows_in_one_hour_and_one_bucket(spark):
    import random

    from creditloom.operators import studies as st

    rng = random.Random(5)
    rows = [(k, datetime(2024, 1, 3, 7, rng.randrange(60), rng.randrange(60)), rng.randrange(9), 1e6 + rng.random() * 1e-3) for k in range(3000)]
    usage = spark.createDataFrame(rows, "event_id long, ts timestamp, units long, value double")
    charged, total = {}, 0
    for k, _, units, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        total += units
        charged[k] = total
    got = hy.budget_ledger(usage, F.date_format("ts", "yyyy-MM"), total // 2)
    assert {r["event_id"]: r["charged"] for r in got.collect()} == charged
    assert "_hour" not in got.columns
    values = sorted(r[3] for r in rows)
    picked = st.nearest_rank(usage.withColumn("g", F.lit("all")), "g", "value").first()
    assert [picked["p50"], picked["p95"], picked["p99"]] == [values[1499], values[2849], values[2969]]
    same = st.nearest_rank(usage.select(F.lit("g").alias("g"), F.lit(4.0).alias("value")), "g", "value").first()
    assert [same["p50"], same["p99"]] == [4.0, 4.0]
