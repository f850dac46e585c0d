"""Streaming windows over logs: budgets per day and plays per listening period."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Policy
from ..operators.listening import rank_history


def daily_usage(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Units per UTC day from a usage log (ts, units).

    Rows later than the watermark are dropped and show up in the query's progress
    as dropped rows.
    """
    days = log.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"))
    return days.agg(F.sum("units").alias("units")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "units")


def over_limit(usage: DataFrame, limit: int) -> DataFrame:
    return usage.withColumn("within_limit", F.col("units") <= limit)


def day_panes(log: DataFrame, item: str, lateness: str = "1 day") -> DataFrame:
    """Plays per listener, item and UTC day of a play log (listener, item, ts), once the day is closed.

    Rows later than the watermark are dropped and counted in the query's progress, under this
    operator's ``numRowsDroppedByWatermark``.
    """
    days = log.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("day"), "listener", item)
    return days.agg(F.count(F.lit(1)).alias("plays"))


def windowed_plays(log: DataFrame, item: str, days: int = 7, slide_days: int = 1, lateness: str = "1 day") -> DataFrame:
    """Plays per listener and item in sliding windows of days.

    Two chained aggregates: plays become day panes, and only panes are copied into the
    windows that hold them.
    """
    panes = day_panes(log, item, lateness)
    windows = F.window(F.window_time("day"), f"{days} days", f"{slide_days} days").alias("window")
    return (
        panes.groupBy(windows, "listener", item).agg(F.sum("plays").alias("play_count"))
        .select(F.col("window.end").alias("as_of"), "listener", item, "play_count")
    )


def start_panes(log: DataFrame, item: str, path: str, checkpoint: str, lateness: str = "1 day", once: bool = False) -> StreamingQuery:
    """Append closed day panes to a table with one folder per batch; ``listening.plays_of_days`` makes all six periods of it."""
    panes = day_panes(log, item, lateness).select("listener", item, F.to_date("day.start").alias("day"), "plays")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = panes.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 minutes")).start()


def start_top_tracks(
    log: DataFrame, item: str, path: str, checkpoint: str, days: int = 7, policy: Policy = DEFAULT, once: bool = False
) -> StreamingQuery:
    """Write ranked tracks of each closed window, one folder per batch.

    A replayed batch overwrites its own folder, so a retry leaves no second copy.
    """
    plays = windowed_plays(log, item, days)

    def step(batch: DataFrame, batch_id: int) -> None:
        per_window = batch.withColumn("period", F.date_format("as_of", "yyyy-MM-dd"))
        rank_history(per_window, policy.max_tracks, tie=item, policy=policy).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = plays.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 minutes")).start()
