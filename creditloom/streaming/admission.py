"""Streaming admission of hydration requests under a backlog and a daily budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Policy
from ..operators.admission import decide, new_jobs

#: State with a time to live needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROW = "request_id string, ts timestamp, kind string, target_mbid string"


class SeenTargets(StatefulProcessor):
    """Lets each target of a request pass once.

    A request's targets are kept as a map with a time to live, so that a client's repeats are
    dropped for that long and the state then goes by itself, whatever the times in the rows.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string, target_mbid string", "at timestamp", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            fresh = []
            for row in batch.itertuples(index=False):
                # A null is no key of a map; such a target makes its request invalid, and passes.
                target = (row.kind or "", row.target_mbid or "")
                if not self.seen.containsKey(target):
                    self.seen.updateValue(target, (row.ts.to_pydatetime(),))
                    fresh.append(row)
            if fresh:
                yield pd.DataFrame(fresh, columns=list(batch.columns))[["request_id", "ts", "kind", "target_mbid"]]

    def close(self) -> None:
        pass


def unseen(requests: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """The stream without targets that their request named before, within the time to live."""
    rows = requests.select("request_id", "ts", "kind", "target_mbid")
    return rows.groupBy("request_id").transformWithStateInPandas(SeenTargets(ttl_ms), _ROW, "append", "processingTime")


def start_admission(
    requests: DataFrame,
    read_jobs: Callable[[SparkSession], DataFrame],
    append_jobs: Callable[[DataFrame, int], None],
    snapshot_version: str,
    checkpoint: str,
    ttl_ms: int = 86_400_000,
    policy: Policy = DEFAULT,
    once: bool = False,
    answer: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Admit a stream of request targets (request_id, ts, kind, target_mbid).

    Repeats are dropped by the stream's state. The budget is global, so a micro-batch is
    decided against the job table, all its days in the same rounds. ``append_jobs`` and
    ``answer`` get the batch id, so that a replayed batch can be recognized.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            jobs = read_jobs(batch.sparkSession)
            decisions = decide(batch, jobs, policy).persist()
            append_jobs(new_jobs(batch, decisions, jobs, snapshot_version), batch_id)
            if answer is not None:
                answer(decisions, batch_id)
            decisions.unpersist()
        finally:
            batch.unpersist()

    writer = unseen(requests, ttl_ms).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    # State that expires by the clock asks for another batch for ever, so "what is there now" is one batch.
    return (writer.trigger(once=True) if once else writer.trigger(processingTime="2 minutes")).start()
