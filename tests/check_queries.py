"""Run registered queries against DuckDB: python tests/check_queries.py [sf_dir] [name part ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from creditloom.session import local_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con, sql, bad = local_session(8), connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                rows, fault = compare(run(spark, sf_dir), con, sql[name])
            else:
                rows, fault = run(spark, sf_dir).count(), None
        except Exception as error:  # noqa: BLE001
            rows, fault = -1, f"{type(error).__name__}: {str(error)[:700]}"
        bad += fault is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if fault else 'ok  '} {kind} {time.time() - start:6.2f}s {rows:>8} {name} {fault or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
