"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs twice in one session and all its rows are computed (no limit, no
collect). ``queries`` holds the second run, ``first`` the first one; ``ingest`` is the
building of the stored tables from raw JSON. ``value`` sums the second runs of ``HEADLINE``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "scan_channel_day",
    "scan_channel_range",
    "scan_all_channels_day",
    "user_activity",
    "user_engagement",
    "hourly_heat_map",
    "channel_comparison",
    "emoji_usage",
    "cross_channel_tickets",
    "ticket_rollup",
    "enriched_channel_day",
    "enriched_all_channels",
    "mentions_by_ticket_status",
    "resolved_mentions",
    "rebuilt_threads",
    "thread_table",
    "channel_engagement",
    "hour_buckets",
    "user_timeline",
    "users_across_channels",
    "topic_states",
    "whole_channel_views",
    "thread_reports",
    "upsert_messages",
]

# Timed too, but not part of the sum, which stays comparable with earlier rounds.
MORE = [
    "channel_day_views",
    "rolling_window_views",
    "bucketed_day_views",
    "window_digests",
    "delimited_messages",
    "prompt_corpus",
    "near_duplicate_pairs",
    "names_resolved",
    "message_numbers_without_times",
    "kept_ticket_rollup",
    "streamed_without_repeats",
    "streamed_sliding_counts",
]


def main() -> None:
    from workload import CATALOG
    from workload.adapter import chat

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        start = time.perf_counter()
        run()
        return round(time.perf_counter() - start, 3)

    tables = chat(spark, sf_dir)
    ingest = timed(lambda: tables.root)
    first, second = {}, {}
    for name in sys.argv[1:] or [*HEADLINE, *MORE]:
        def run(query=CATALOG[name]) -> None:
            query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()

        first[name], second[name] = timed(run), timed(run)
    print(
        json.dumps(
            {
                "metric": "headline_queries_second_run",
                "value": round(sum(t for n, t in second.items() if n not in MORE), 3),
                "unit": "sec",
                "queries": second,
                "first": first,
                "ingest": ingest,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cores": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
