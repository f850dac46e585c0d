"""Admission of hydration requests, decided in order of arrival, for any span of days at once.

A request names targets. It is taken whole or refused whole: its fresh units (targets neither
queued nor brought by a request taken before it) must fit both the backlog and the budget of
its day, and a day answers no more than ``daily_calls`` requests. Each decision depends on all
decisions before it, but only a request that brings fresh units changes anything, and all of
these together fit the backlog: what is brought anew is a table of ``max_pending_units`` rows
at most. Days on which nothing fresh fits are passed over by one grouping. From the first day
on which something does, a stretch of whole days is walked in order, then the next such day is
looked for. Where the backlog is full the rest needs no walk, however many days it has. All
answers then follow from that table by one join and prefix sums. The driver sees two days and
a sum a stretch.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Policy
from ..functions import canonical_mbid, day_key, seconds_until_tomorrow
from ..session import cut_lineage
from .hydration import units

if TYPE_CHECKING:
    import pandas as pd

TARGET = ["kind", "target_mbid"]

#: Answers of a refused request, and after how many seconds it may ask again (null: next day).
INVALID, DAILY, BUSY = "invalid_request", "hydration_daily_budget", "hydration_busy"
BUSY_SECONDS = 120


def valid_targets(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Canonical ids, and ``ok``: whether kind and id are well formed."""
    mbid = canonical_mbid(F.col("target_mbid"), strict=strict)
    ok = F.col("kind").isin("track", "recording", "artist") & mbid.isNotNull()
    return raw.withColumns({"target_mbid": F.coalesce(mbid, F.col("target_mbid")), "ok": F.coalesce(ok, F.lit(False))})


def _before(value: str, within: list[str], *by: str) -> Column:
    rows = Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def decide(requests: DataFrame, jobs: DataFrame, policy: Policy = DEFAULT, strict: bool = True, stretch_rows: int = 100_000) -> DataFrame:
    """One row a request: request_id, ts, day, admitted, code, retry_after, accepted, fresh_units, backlog_units, used_units.

    ``requests`` holds (request_id, ts, kind, target_mbid), a row a target; a request's time
    is its first row's, ties go by id. ``jobs`` is the job table: what is queued is free, and
    counts towards the backlog and the usage of the day it was made on. One malformed target
    refuses its request. ``backlog_units`` and ``used_units`` are those met on arrival. A
    stretch has ``stretch_rows`` rows, or one day.
    """
    checked = valid_targets(requests, strict)
    asked = checked.groupBy("request_id").agg(F.min("ts").alias("ts"), F.bool_and("ok").alias("ok"))
    asked = asked.withColumn("day", day_key(F.col("ts")))
    # Answers of a day are numbered; the bound trims each task's rows before the shuffle.
    calls = Window.partitionBy("day").orderBy("ts", "request_id")
    called = asked.where("ok").withColumn("call", F.row_number().over(calls)).where(F.col("call") <= policy.daily_calls)
    called = cut_lineage(called.select("request_id", "ts", "day", "call"))

    key = [F.col("target_kind").alias("kind"), "target_mbid"]
    queued = jobs.select(*key).distinct()
    size = units(F.col("target_kind"))
    open_ = (F.col("status") != "complete") & ((F.col("status") == "processing") | (F.col("attempts") < policy.max_attempts))
    backlog = jobs.agg(F.coalesce(F.sum(F.when(open_, size)), F.lit(0)).alias("_backlog"))
    used = jobs.groupBy(day_key(F.col("created_at")).alias("day")).agg(F.sum(size).alias("_used"))
    # What requests may bring, with their place in the order of arrival.
    brought = checked.where("ok").select("request_id", *TARGET).distinct().join(called, "request_id").join(queued, TARGET, "left_anti")
    brought = cut_lineage(brought.select(*TARGET, F.struct("day", "call").alias("place"), units(F.col("kind")).alias("units")))
    days = called.select("day").distinct().join(used, "day", "left").select("day", F.coalesce("_used", F.lit(0)).alias("_used"))
    days = cut_lineage(days.select("day", "_used", backlog.scalar().alias("_backlog")))

    decided = _answers(called, brought, days, _taken(brought, days, policy, stretch_rows), policy)

    targets = checked.where("ok").select("request_id", *TARGET).distinct().groupBy("request_id").agg(F.count(F.lit(1)).alias("accepted"))
    told = decided.drop("call").join(targets, "request_id")
    fits_day = F.col("used_units") + F.col("fresh_units") <= policy.daily_new_units
    told = told.withColumn("code", F.when(F.col("admitted"), F.lit(None)).when(fits_day, BUSY).otherwise(DAILY))
    others = asked.join(called.select("request_id"), "request_id", "left_anti").select(
        "request_id", "ts", "day", F.lit(False).alias("admitted"), F.when(F.col("ok"), DAILY).otherwise(INVALID).alias("code")
    )
    rows = told.unionByName(others, allowMissingColumns=True)
    wait = F.when(F.col("code") == DAILY, seconds_until_tomorrow(F.col("ts"))).when(F.col("code") == BUSY, F.lit(BUSY_SECONDS))
    return rows.select(
        "request_id", "ts", "day", "admitted", "code", wait.cast("bigint").alias("retry_after"),
        F.when(F.col("admitted"), F.col("accepted")).otherwise(0).cast("bigint").alias("accepted"),
        *(F.col(c).cast("bigint").alias(c) for c in ("fresh_units", "backlog_units", "used_units")),
    )


def _taken(brought: DataFrame, days: DataFrame, policy: Policy, stretch_rows: int) -> DataFrame:
    """The targets that requests bring into the queue, with the place of the request that does."""
    taken, after = brought.limit(0), None
    while True:
        backlog = days.agg(F.coalesce(F.max("_backlog"), F.lit(0))).first()[0] + taken.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
        left = brought if after is None else brought.where(F.col("place.day") > after).join(taken, TARGET, "left_anti")
        asked = left.groupBy("place").agg(F.sum("units").alias("fresh"), F.count(F.lit(1)).alias("rows")).withColumn("day", F.col("place.day"))
        # With all that may be queued before it, a request of more units than the backlog has room for stays too large.
        asked = asked.where(F.col("fresh") <= policy.max_pending_units - backlog)
        by_day = asked.join(days, "day").groupBy("day").agg(
            F.sum("rows").alias("rows"), F.bool_or(F.col("_used") + F.col("fresh") <= policy.daily_new_units).alias("opens")
        )
        # One row a day.
        until = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        opened = by_day.withColumn("_open", F.bool_or("opens").over(until)).where("_open").withColumn("_rows", F.sum("rows").over(until))
        first, last = opened.agg(F.min("day"), F.coalesce(F.max(F.when(F.col("_rows") <= stretch_rows, F.col("day"))), F.min("day"))).first()
        if first is None:
            return taken
        stretch = left.join(asked.where(F.col("day").between(first, last)).select("place", "day"), "place").join(days.select("day", "_used"), "day")
        stretch = stretch.select(*TARGET, "day", "place.call", "units", "_used", F.lit(backlog).alias("_backlog"))
        new = stretch.groupBy().applyInPandas(_walk(policy.daily_new_units, policy.max_pending_units), "kind string, target_mbid string, day string, call int, units int")
        new = new.select(*TARGET, F.struct("day", "call").alias("place"), "units")
        taken, after = cut_lineage(taken.unionByName(new).coalesce(1)), last


def _walk(daily_new_units: int, max_pending_units: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Decides the requests of some days in order; the rows are the targets that were not queued before these days."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows.sort_values(["day", "call"])
        backlog, today, now, seen, kept = int(rows["_backlog"].iloc[0]), 0, None, set(), []
        columns = zip(asked["day"], asked["call"], asked["kind"], asked["target_mbid"], asked["units"], asked["_used"], range(len(asked)))
        for (day, _), request in groupby(columns, lambda r: r[:2]):
            fresh = [r for r in request if r[2:4] not in seen]
            size = int(sum(r[4] for r in fresh))
            if fresh and day != now:
                now, today = day, int(fresh[0][5])
            if fresh and today + size <= daily_new_units and backlog + size <= max_pending_units:
                backlog, today = backlog + size, today + size
                seen.update(r[2:4] for r in fresh)
                kept.extend(r[6] for r in fresh)
        return asked.iloc[kept][[*TARGET, "day", "call", "units"]]

    return walk


def _answers(called: DataFrame, brought: DataFrame, days: DataFrame, taken: DataFrame, policy: Policy) -> DataFrame:
    """Every numbered request with what it met and whether it is admitted, from the targets that were taken."""
    firsts = taken.select(*TARGET, F.col("place").alias("_first"))
    fresh = brought.join(firsts, TARGET, "left").where(F.col("_first").isNull() | (F.col("_first") >= F.col("place")))
    sizes = fresh.groupBy("place").agg(F.sum("units").alias("fresh_units"))
    charges = taken.groupBy("place").agg(F.sum("units").alias("_charged"))
    rows = called.withColumn("place", F.struct("day", "call")).join(sizes, "place", "left").join(charges, "place", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fresh_units", "_charged")})
    by_day = rows.groupBy("day").agg(F.sum("_charged").alias("_day"))
    # One row a day: the only sum that runs over all of them.
    by_day = by_day.withColumn("_earlier", F.coalesce(F.sum("_day").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_today", _before("_charged", ["day"], "call")).join(by_day.join(days, "day"), "day")
    rows = rows.withColumns({
        "used_units": F.col("_used") + F.col("_today"),
        "backlog_units": F.col("_backlog") + F.col("_earlier") + F.col("_today"),
    })
    fits = (F.col("used_units") + F.col("fresh_units") <= policy.daily_new_units) & (F.col("backlog_units") + F.col("fresh_units") <= policy.max_pending_units)
    rows = rows.withColumn("admitted", (F.col("fresh_units") == 0) | fits)
    return rows.select("request_id", "ts", "day", "call", "admitted", "fresh_units", "backlog_units", "used_units")


def new_jobs(requests: DataFrame, decisions: DataFrame, jobs: DataFrame, snapshot_version: str) -> DataFrame:
    """Pending jobs for the fresh targets of the admitted requests."""
    taken = valid_targets(requests).join(decisions.where("admitted").select("request_id"), "request_id", "left_semi")
    firsts = taken.groupBy(F.lit(snapshot_version).alias("snapshot_version"), F.col("kind").alias("target_kind"), "target_mbid").agg(F.min("ts").alias("created_at"))
    key = ["snapshot_version", "target_kind", "target_mbid"]
    return firsts.join(jobs.select(*key), key, "left_anti").select(
        F.xxhash64(*key).alias("id"),
        *key,
        F.substring("target_mbid", 1, F.when(F.col("target_kind") == "artist", 3).otherwise(4)).alias("shard_key"),
        F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
