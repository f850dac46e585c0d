"""Cohort reach study, request-log percentiles and the seeded example sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Play multiplier of each listening period in the example history.
PERIOD_MULTIPLIERS = {"7day": 1, "1month": 2, "3month": 5, "6month": 8, "12month": 14, "overall": 24}


def layer_reach(tracks: DataFrame, direct: DataFrame, release: DataFrame, recurrent: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Tracks and plays each evidence layer reaches, per cohort and pooled (null cohort).

    ``direct`` and ``release`` hold (recording_mbid, family_slug); ``recurrent`` holds
    (artist_mbid, family_slug). Each is cut to one row per key before it joins.
    """
    def marks(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.lit(True).alias(name), F.bool_or(F.col("family_slug") != "voice").alias(f"{name}_x"))

    flagged = (
        tracks.join(marks(direct, "recording_mbid", "d"), "recording_mbid", "left")
        .join(marks(release, "recording_mbid", "r"), "recording_mbid", "left")
        .join(marks(recurrent, "artist_mbid", "a"), "artist_mbid", "left")
    )
    on = {n: F.coalesce(n, F.lit(False)) for n in ("d", "r", "a", "d_x", "r_x", "a_x")}
    layers = {
        "direct": on["d"],
        "direct_or_release": on["d"] | on["r"],
        "recurrent": on["a"],
        "any_layer": on["d"] | on["r"] | on["a"],
        "direct_without_voice": on["d_x"],
        "any_without_voice": on["d_x"] | on["r_x"] | on["a_x"],
    }
    measures = [F.count(F.lit(1)).alias("tracks"), F.sum("play_count").alias("plays")]
    for name, flag in layers.items():
        measures.append(F.count_if(flag).alias(f"{name}_tracks"))
        measures.append(F.sum(F.when(flag, F.col("play_count")).otherwise(0)).alias(f"{name}_plays"))
    return flagged.rollup(cohort).agg(*measures)


def nearest_rank(rows: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = 8192, margin: float = 0.003) -> DataFrame:
    """Exact nearest-rank percentiles per group, guided by a sketch.

    A KLL sketch of each group gives two values around each percentile. One pass then counts
    what lies below the lower one and, value by value, what lies between; all else falls into
    one row per group before the shuffle. The last window orders only the distinct values
    between the two, ``2 * margin`` of a group's ranks. ``margin`` is four times the error
    that a sketch of this ``k`` keeps in 99 of 100 cases; should a rank ever lie outside, the
    query fails instead of giving a near value.
    """
    v = F.col("_v")
    given = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("_v"))
    sketches = given.groupBy(group).agg(F.kll_sketch_agg_double(v.cast("double"), k).alias("_s"), F.count(F.lit(1)).alias("_all"))

    def near(p: float) -> Column:
        return F.struct(
            F.lit(p).alias("_p"), F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(p))).alias("_rank"),
            F.kll_sketch_get_quantile_double("_s", F.lit(max(0.0, p - margin))).alias("_from"),
            F.kll_sketch_get_quantile_double("_s", F.lit(min(1.0, p + margin))).alias("_to"),
        )

    bounds = sketches.select(group, F.array(*map(near, shares)).alias("_near"))
    inside = F.exists("_near", lambda b: v.cast("double").between(b["_from"], b["_to"]))
    lower = [F.when(v.cast("double") < F.get("_near", F.lit(i))["_from"], 1).otherwise(0).alias(f"_b{i}") for i in range(len(shares))]
    placed = given.join(bounds, group).select(group, F.when(inside, v).alias("_at"), *lower)
    counts = placed.groupBy(group, F.col("_at").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(shares))])
    whole = Window.partitionBy(group)
    lows = F.array(*[F.sum(f"_b{i}").over(whole) for i in range(len(shares))])
    held = counts.select(group, "_v", "_n", lows.alias("_lows")).where("_v is not null").join(bounds, group)
    each = held.select(group, "_v", "_n", "_lows", F.posexplode("_near").alias("_i", "_b")).select(group, "_v", "_n", F.get("_lows", F.col("_i")).alias("_below"), "_b.*")
    each = each.where(v.cast("double").between(F.col("_from"), F.col("_to")))
    run = F.sum("_n").over(Window.partitionBy(group, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_below")
    found = each.withColumn("_run", run).groupBy(group, "_p", "_rank", "_below").agg(F.min(F.when(F.col("_run") >= F.col("_rank"), v)).alias("_v"))
    missed = F.raise_error(F.lit("a percentile lies outside the sketch's bounds")).cast(found.schema["_v"].dataType)
    sure = F.when((F.col("_below") < F.col("_rank")) & v.isNotNull(), v).otherwise(missed)
    named = [F.max(F.when(F.col("_p") == p, F.col("_sure"))).alias(f"p{round(p * 100)}") for p in shares]
    return found.withColumn("_sure", sure).groupBy(group).agg(*named)


def request_log_summary(log: DataFrame, accepted: Column) -> DataFrame:
    """Requests, accepted, span and rate per code, with latency percentiles.

    ``log`` holds code, ts, latency and retry_after.
    """
    per_code = log.groupBy("code").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(accepted).alias("accepted"),
        F.min("retry_after").alias("retry_after_min"),
        F.max("retry_after").alias("retry_after_max"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("_micros"),
    )
    rate = F.when(F.col("_micros") > 0, F.col("accepted") / (F.col("_micros") / 1_000_000.0))
    return per_code.withColumn("accepted_per_second", rate).drop("_micros").join(nearest_rank(log, "code", "latency"), "code", "left")


#: Rows of a kind that are ranked for a sample, as a multiple of its size; see ``example_sample``.
_KEPT = 20


def example_sample(
    recordings: DataFrame, priority: DataFrame, seed: str, period: str = "overall", target: int = 15, per_artist: int = 3
) -> DataFrame:
    """A reproducible example history for each ``sample_id``.

    ``recordings`` holds sample_id, recording_mbid, artist_id and direct; ``priority``
    holds the artist ids to include first. Order within a stratum is a digest of seed
    and id. A priority artist's first recording always enters; direct recordings then
    fill two thirds of the target, the others the rest, and what is left of either
    stands in where the other falls short. An artist without a recording goes first, and none
    has more than ``per_artist``.

    One pass: recordings are ranked per artist and stratum, then the three fillings follow as
    marks on the same rows, by running ranks. Each kind of row (of a priority artist or not,
    direct or not, an artist's first or not) is cut to ``_KEPT * target`` a sample before.
    That loses nothing: a filling takes fewer than ``target`` rows, so it passes over the rows
    of fewer than three times as many artists, of at most twice ``per_artist`` rows each; and
    a later row of an artist is only wanted where all artists together are that few. So no
    window holds more than a fixed number of rows, and calling this starts no job.
    """
    target, sample = max(5, target), Window.partitionBy("sample_id")
    # A recording enters once, whoever is named for it.
    unique = recordings.groupBy("sample_id", "recording_mbid").agg(F.min("artist_id").alias("artist_id"), F.bool_or("direct").alias("direct"))
    known = priority.select("artist_id").distinct().withColumn("_p", F.lit(True))
    drawn = unique.withColumn("_h", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("recording_mbid")))).join(known, "artist_id", "left")
    drawn = drawn.withColumn("_p", F.coalesce("_p", F.lit(False)))
    strata = drawn.groupBy("sample_id").agg((F.lit(target) - F.least(F.count_if(~F.col("direct")), F.lit(target // 3))).alias("_room"))

    in_stratum = Window.partitionBy("sample_id", "artist_id", "direct").orderBy("_h", "recording_mbid")
    rows = drawn.withColumn("_k", F.row_number().over(in_stratum)).where(F.col("_k") <= per_artist)
    artist = Window.partitionBy("sample_id", "artist_id")
    rows = rows.withColumn("_has", F.bool_or("direct").over(artist))
    leads = (F.col("_k") == 1) & (F.col("direct") | ~F.col("_has"))
    rows = rows.withColumns({"_leads": leads, "_first": F.col("_p") & leads})
    firsts = rows.where("_first")
    entered = firsts.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_entered"))
    kind = Window.partitionBy("sample_id", "_p", "direct", F.col("_k") == 1, "_leads").orderBy("_h", "recording_mbid")
    pool = rows.where(~F.col("_first")).withColumn("_n", F.row_number().over(kind)).where(F.col("_n") <= _KEPT * target)
    pool = pool.join(strata, "sample_id").join(entered, "sample_id", "left").withColumns({"_held": F.col("_p").cast("int"), "_all": F.coalesce("_entered", F.lit(0))})

    def fill(rows: DataFrame, able: Column, i: Column, room: Column) -> DataFrame:
        """Mark what a filling takes, and count it for its artist and sample."""
        rows = rows.withColumns({"_i": i}).withColumn("_able", able & ~F.col("_taken") & (F.col("_i") <= per_artist))
        order = sample.orderBy(F.desc("_able"), F.col("_i") > 1, F.desc("direct"), "_h", "recording_mbid")
        took = F.col("_able") & (F.row_number().over(order) <= room)
        rows = rows.withColumn("_took", took).withColumns({"_taken": F.col("_taken") | F.col("_took")})
        more = F.col("_took").cast("int")
        return rows.withColumns({"_held": F.col("_held") + F.sum(more).over(artist), "_all": F.col("_all") + F.sum(more).over(sample)})

    pool = pool.withColumn("_taken", F.lit(False))
    # A priority artist's first recording is counted with the others, so ranks stay as they are.
    pool = fill(pool, F.col("direct"), F.col("_k"), F.col("_room"))
    lost = (F.col("_p") & ~F.col("_has")).cast("int")
    pool = fill(pool, ~F.col("direct"), F.col("_k") - lost + F.col("_held"), F.lit(target) - F.col("_all"))
    left = F.row_number().over(artist.orderBy("_taken", F.desc("direct"), "_h", "recording_mbid"))
    pool = fill(pool, F.lit(True), left + F.col("_held"), F.lit(target) - F.col("_all"))

    columns = ["sample_id", "recording_mbid", "artist_id", "direct", "_h", "_p"]
    selected = firsts.select(*columns).unionByName(pool.where("_taken").select(*columns))
    draw = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") % 11 + 2
    plays = F.when(F.col("_p"), F.lit(12)).otherwise(draw) * PERIOD_MULTIPLIERS[period]
    return selected.select("sample_id", "recording_mbid", "artist_id", "direct", plays.cast("bigint").alias("play_count"))
