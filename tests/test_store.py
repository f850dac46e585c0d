"""Sharded and clustered tables, digests kept up, counts that add up, JSON rows, day panes."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from creditloom import functions as fn
from creditloom.operators import counts as co
from creditloom.operators import listening as ls
from creditloom.operators import tables as tb
from creditloom.sources import sinks as sk
from creditloom.sources import store
from creditloom.streaming import usage as us

NOW = datetime(2024, 1, 10, 12)
STATE = "id string, status string, made int, shard string"


def files(path):
    return {p.relative_to(path): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}


def test_upsert_rewrites_touched_shards_only(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    shard = lambda i: f"0{i % 10}"
    old = spark.createDataFrame([(f"k{i:03d}", "pending", i, shard(i)) for i in range(200)], STATE)
    store.write_sharded(old, path, "shard")
    before = files(path)
    assert {str(p.parent) for p in before} == {f"shard=0{i}" for i in range(10)}
    new = spark.createDataFrame([("k003", "complete", -1, "03"), ("k013", "failed", -1, "03"), ("n1", "new", 5, "07"), ("n2", "new", 6, "99")], STATE)
    for _ in range(2):
        assert store.upsert_sharded(spark, path, new, ["id"], "shard", STATE, keep=("made",)) == ["03", "07", "99"]
        after = files(path)
        changed = {str(p.parent) for p in set(before.items()) ^ set(after.items()) for p in [p[0]]}
        assert changed == {"shard=03", "shard=07", "shard=99"}
        assert rows(store.read_sharded(spark, path, "shard", schema=STATE).select(*old.columns)) == rows(tb.upsert(old, new, ["id"], keep=("made",)))
    plan = store.read_sharded(spark, path, "shard", ["03"], STATE)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan or "03" in plan.split("PartitionFilters")[1].split("]")[0]
    assert store.upsert_sharded(spark, path, new.limit(0), ["id"], "shard", STATE) == []


def read_rows(df):
    """Rows a finished query's scans gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


def test_lookup_reads_what_is_asked_for(spark, rows, tmp_path):
    path = str(tmp_path / "c")
    rng = random.Random(2)
    given = [(f"{rng.getrandbits(64):016x}", k) for k in range(20_000)]
    table = spark.createDataFrame(given, "id string, k int")
    store.write_clustered(table, path, "id", files=4, rows_per_group=500)
    stored = spark.read.parquet(path)
    asked = sorted(rng.sample(given, 3))
    requests = spark.createDataFrame([(i,) for i, _ in asked] + [("absent",), (None,), (asked[0][0],)], "id string")
    found = store.lookup(stored, requests, "id")
    assert rows(found) == asked
    # Each of three keys is in one row group of 500; the scan opens few more.
    assert read_rows(found) <= 6 * 500 < stored.count()
    assert rows(store.lookup(stored, requests, "id", listed=2)) == asked
    assert store.lookup(stored, requests.limit(0), "id").count() == 0


def test_readers_see_the_version_published_last(spark, tmp_path):
    log = str(tmp_path / "log")
    store.publish_version(spark, log, "v1", F.lit(NOW))
    assert store.current_version(spark, log) == "v1"
    first = files(log)
    store.publish_version(spark, log, "v2", F.lit(NOW + timedelta(1)))
    store.publish_version(spark, log, "v0", F.lit(NOW + timedelta(hours=1)))
    assert store.current_version(spark, log) == "v2" and first.items() <= files(log).items()


def test_digest_after_changes(spark):
    schema = "k int, v string"
    old = spark.createDataFrame([(i, f"v{i % 7}") for i in range(60)], schema)
    new = spark.createDataFrame([(3, "x"), (4, None), (70, "y"), (59, "z")], schema)
    deleted = spark.createDataFrame([(5,), (59,), (999,)], "k int")
    removed, added = sk.change_of(old, new, ["k"], deleted)
    full = tb.upsert(old, new, ["k"]).join(deleted, "k", "left_anti").select("k", "v")
    before = sk.table_stats(old)
    after = sk.table_stats_after(spark, before, removed, added)
    assert after == sk.table_stats(full) and after.digest != before.digest
    # A chain of changes, and back again.
    assert sk.table_stats_after(spark, after, added, removed) == before
    nothing = old.limit(0)
    assert sk.table_stats_after(spark, before, nothing, nothing) == before and sk.table_stats_after(spark, before, old, nothing) == sk.table_stats(nothing)


def test_manifest_goes_on_without_a_scan(spark, tmp_path):
    old = spark.createDataFrame([(i, str(i)) for i in range(20)], "k int, v string")
    stats = sk.write_table(old, str(tmp_path / "t"))
    sk.write_manifest(spark, str(tmp_path / "m1"), "s", "v1", {"t": stats}, "g")
    read = sk.manifest_tables(sk.read_manifest(spark, str(tmp_path / "m1"), "s", "v1"))
    assert read == {"t": stats}
    added = spark.createDataFrame([(100, "new")], "k int, v string")
    after = sk.table_stats_after(spark, read["t"], old.where("k = 3"), added)
    digest = sk.write_manifest(spark, str(tmp_path / "m2"), "s", "v2", {"t": after}, "g", parent_hash=sk.manifest_hash(read))
    whole = sk.table_stats(old.where("k <> 3").unionByName(added))
    assert digest == sk.manifest_hash({"t": whole})


def test_bitmaps_add_up(spark):
    rng = random.Random(1)
    given = [[(rng.choice("abc"), rng.choice([None, 0, 1, 32768, 32769, rng.randrange(100_000)])) for _ in range(400)] for _ in range(2)]
    frames = [co.distinct_bitmaps(spark.createDataFrame(g, "k string, n bigint"), ["k"], F.col("n")) for g in given]
    sets = [{k: {n for q, n in g if q == k and n is not None} for k in "abc"} for g in given]
    count = lambda df: {r.k: r.distinct for r in co.distinct_counts(df, ["k"]).collect()}
    assert count(frames[0]) == {k: len(v) for k, v in sets[0].items()}
    assert count(co.unite(*frames)) == {k: len(sets[0][k] | sets[1][k]) for k in "abc"}
    assert count(co.common(*frames)) == {k: len(sets[0][k] & sets[1][k]) for k in "abc"}
    assert co.distinct_counts(frames[0].limit(0).drop("k"), []).first()[0] == 0


def test_sparse_bitmaps_cost_a_short_row_a_number(spark):
    """Numbers far apart: one key, a thousand numbers, no more than a bigint each."""
    bits = co.distinct_bitmaps(spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") * 100_000).alias("n")), ["k"], F.col("n"))
    assert dict(bits.dtypes)["bits"] == "bigint" and bits.count() == 1000
    assert co.distinct_counts(bits, ["k"]).first().distinct == 1000
    assert co.distinct_bitmaps(spark.range(640).select(F.lit("a").alias("k"), "id"), ["k"], F.col("id")).count() == 10


def test_json_rows(spark, rows):
    body = {"a": 1, "b": {"c": [True, None, {"d": "x"}], "e": {}}, "f": "t"}
    given = [(1, json.dumps(body)), (2, "[1, [2]]"), (3, "no json"), (4, "5"), (5, None)]
    got = rows(fn.unnest_json(spark.createDataFrame(given, "id int, payload string"), "payload"), "id", "path", "key", "position", "kind", "value")
    assert got == sorted(
        [
            (1, "a", "a", 0, "number", "1"), (1, "b.c[0]", None, 0, "boolean", "true"), (1, "b.c[1]", None, 1, "null", None),
            (1, "b.c[2].d", "d", 0, "string", "x"), (1, "f", "f", 2, "string", "t"), (2, "[0]", None, 0, "number", "1"), (2, "[1][0]", None, 0, "number", "2"),
        ],
        key=repr,
    )
    shallow = fn.unnest_json(spark.createDataFrame(given[:1], "id int, payload string"), "payload", depth=1)
    assert {(r.path, r.kind) for r in shallow.collect()} == {("a", "number"), ("b", "object"), ("f", "string")}


def test_panes_make_all_periods(spark, tmp_path):
    """Streamed day panes give the periods that the whole log gives; late rows are counted."""
    rng = random.Random(9)
    schema = "listener string, item string, ts timestamp"
    start = datetime(2023, 1, 1)
    given = [(rng.choice("uv"), rng.choice("xyz"), start + timedelta(hours=rng.randrange(24 * 500))) for _ in range(400)]
    given.sort(key=lambda g: g[2])
    source, table = str(tmp_path / "log"), str(tmp_path / "panes")
    spark.createDataFrame(given, schema).coalesce(1).write.parquet(source)

    def run():
        query = us.start_panes(spark.readStream.schema(schema).parquet(source), "item", table, str(tmp_path / "cp"), once=True)
        query.awaitTermination()
        return query

    run()
    # One row far ahead closes all days before it; one row comes too late.
    spark.createDataFrame([("u", "x", given[-1][2] + timedelta(30))], schema).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("u", "x", given[0][2])], schema).write.mode("append").parquet(source)
    late = run()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in late.recentProgress for o in p["stateOperators"])
    assert dropped == 1
    panes = spark.read.parquet(table).drop("batch")
    log = spark.createDataFrame(given, schema)
    as_of = F.lit(given[-1][2].date())
    want = {tuple(r) for r in ls.plays_in_periods(log, as_of).select("listener", "period", "item", "play_count").collect()}
    got = {tuple(r) for r in ls.plays_of_days(panes, as_of).select("listener", "period", "item", "play_count").collect()}
    assert got == want and {r[1] for r in want} == set(ls.PERIOD_DAYS)
    brute = {}
    for listener, item, ts in given:
        age = (given[-1][2].date() - ts.date()).days
        for period, days in ls.PERIOD_DAYS.items():
            if days is None or age < days:
                brute[listener, period, item] = brute.get((listener, period, item), 0) + 1
    assert {r[:3]: r[3] for r in want} == brute
