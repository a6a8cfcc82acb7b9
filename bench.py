"""Headline timings: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

``ingest`` normalises, redacts and stores every source event and enriches its prompts, without the
merge of a running ingest job; the questions then read the stored log. Each question is run once to warm up and then ``BENCH_RUNS``
times (one by default); the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
QUESTIONS = (
    "daily_usage", "totals", "active_time_by_day", "buckets_by_hour", "by_category", "by_project",
    "technology_contexts", "models_with_share", "session_list", "session_metrics",
    "project_details", "folded_projects", "prompt_model_attribution", "following_tools",
    "next_response", "idempotent_merge", "repeated_prompts", "themes", "prompt_search",
    "activity_page", "daily_rollups", "daily_active", "overview_from_rollups",
    "period_over_period", "transcript_events", "export_rows",
)


def main() -> None:
    from usagelake import build_session
    from usagelake.sources.store import EventStore
    from workload import questions
    from workload import views as v

    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def clock(run) -> float:
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    timings["ingest_cold"] = clock(lambda: v.store(spark, SF_DIR))
    again = EventStore(spark, tempfile.mkdtemp(prefix="usagelake-bench-"), by_provider=False)
    timings["ingest"] = clock(lambda: v.ingest(spark, SF_DIR, again))
    for name in QUESTIONS:
        def run(name=name):
            df = questions.QUERIES[name](spark, SF_DIR)
            df.write.format("noop").mode("overwrite").save()

        run()
        timings[name] = statistics.median(clock(run) for _ in range(RUNS))
    events = v.tables(spark, SF_DIR).events.count()
    total = sum(timings[q] for q in QUESTIONS)
    print(json.dumps({
        "metric": "sum of median question seconds", "value": round(total, 3), "unit": "sec",
        "queries": {k: round(t, 3) for k, t in timings.items()}, "sf": SF_DIR,
        "cpus": int(CPUS), "events": events,
        "ingest_events_per_sec": round(events / timings["ingest"]),
    }))


if __name__ == "__main__":
    main()
