"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Every query runs in full, into a sink that keeps nothing, BENCH_RUNS times (default 2);
the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellpath.plans.catalog import queries  # noqa: E402
from cellpath.session import local_session  # noqa: E402

HEADLINE = [
    "pings_parse",
    "daily_sequences",
    "slot_dwell",
    "day_slots",
    "day_slots_backfilled",
    "test_sequences_text",
    "kmeans_centres",
    "kmodes_centres",
    "kmodes_centres_pooled",
    "model_kmeans",
    "predict_next",
    "rank_hits",
    "day_vectors_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
