"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) set the input and the cores.
Every query runs to completion into a sink that discards rows; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from chatstream.plans.queries import QUERIES  # noqa: E402
from chatstream.session import build_session  # noqa: E402

#: query -> tables whose rows it reads
HEADLINE = {
    "moderation_reasons": ["conversations"],
    "json_edge_cases": ["events"],
    "rejections_by_reason": ["conversations"],
    "sensitive_first_match": ["documents"],
    "bus_scan": ["events"],
    "bus_encode": ["events"],
    "room_partition": ["events"],
    "rate_limit": ["events"],
    "membership_intervals": ["events"],
    "audience_semi": ["events"],
    "room_sequence": ["events"],
    "room_sequence_bucketed": ["events"],
    "fanout": ["events"],
    "room_ownership": ["events"],
    "route_lookup": ["events"],
    "delivery_report": ["events"],
    "latency_percentiles": ["events"],
    "latency_histogram": ["events"],
    "liveness_timeouts": ["events"],
    "stream_rate_limit": ["events"],
    "stream_sequence": ["events"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(os.cpu_count() if cpus == "*" else cpus),
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    counts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in {t for ts in HEADLINE.values() for t in ts}}
    seconds, rate = {}, {}
    for name, tables in HEADLINE.items():
        best = float("inf")
        for _ in range(1 if name.startswith("stream_") else 2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        seconds[name] = round(best, 3)
        rate[name] = round(sum(counts[t] for t in tables) / best)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rate, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
