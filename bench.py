"""Time of the headline queries at one scale, as one JSON line."""

from __future__ import annotations

import json
import os
import time

from airtally.session import build_session
from airtally.plans import all_queries

HEADLINES = (
    "household_aggregates",
    "household_genre_affinity",
    "standard_segments",
    "lsh_best_match",
    "lsh_pairs_tolerance_8",
    "matched_viewership",
    "ingest_reject_reasons",
    "dedup_60s",
    "sessions_gap300",
    "sessions_by_device_6h",
    "latest_consent",
    "segments_one_pass",
    "segment_sizes",
    "segment_overlap_report",
    "rtb_lookup_fallback",
    "delivery_kpis",
    "monthly_invoices",
    "api_usage_percentiles",
    "partner_statistics",
    "window_rates",
    "retention_effect",
    "stream_sessions",
    "stream_match",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "airtally-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # One small run starts the JVM's code paths, so that no query pays for them.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINES:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
