"""Time the headline queries and print one JSON line.

Each query is planned and run to the end into the no-op sink: one run to warm
up, then the median of three. Environment: BENCH_SF_DIR, BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from changelens.plans.queries import as_callables  # noqa: E402
from changelens.session import local_session  # noqa: E402

HEADLINE = (
    "change_report",
    "snapshot_status",
    "patch_lines",
    "status_counts",
    "preview_files",
    "modules",
    "symbols_all",
    "semantic_changes",
    "test_plan",
    "test_plan_stats",
    "test_files",
    "test_files_last_writer",
    "test_blocks",
    "new_tests",
    "merged_files",
    "integration_stats",
    "coverage_by_type",
    "coverage_from_json",
    "coverage_baseline",
    "coverage_report",
    "coverage_summary",
    "metrics_rollup",
    "response_text",
    "response_cache",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = as_callables()

    def run(name: str) -> float:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
