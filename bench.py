"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input
and the cores. Each query runs whole, its result is computed in full, and the better of
two runs is reported, with the first runs beside it.
"""

from __future__ import annotations

import json
import os
import time

from creditloom.plans import REGISTRY
from creditloom.session import local_session

HEADLINE = [
    "a08_shard_documents",
    "b13_report_contract",
    "c05_direct_evidence",
    "c06_release_context",
    "d02_recurrence_vocabulary",
    "d04_claims",
    "d07_stage_counters",
    "d10_coverage",
    "d14_family_presence",
    "d15_sound_balance",
    "d20_family_scores",
    "d22_vocabulary_gate",
    "d23_featured_artists",
    "d29_request_log",
    "e08_ranked_pages",
    "e12_example_sample",
    "h03_materialized",
    "h06_budget_ledger",
    "h09_top_tracks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "creditloom-bench")
    times: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            # The noop sink computes every row and column without moving them to the driver.
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name], first[name] = round(min(runs), 3), round(runs[0], 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "first_runs": first, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
