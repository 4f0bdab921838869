"""Time the registered queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed
runs (the median counts, after one warm-up), ``BENCH_QUERIES`` a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from textmill.plans import all_queries
from textmill.session import local_session
from textmill.staging import drop_staged


def timed(run, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "textmill-bench")
    chosen = os.environ.get("BENCH_QUERIES")
    queries = {n: q for n, q in all_queries().items() if not chosen or n in chosen.split(",")}
    seconds = {}
    for name, run in queries.items():
        timed(run, spark, sf_dir)
        seconds[name] = round(statistics.median(timed(run, spark, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
        drop_staged(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of the median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
