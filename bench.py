"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Every query runs to the end, its
rows going to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dataheal.plans.queries import all_queries
from dataheal.session import build_session

HEADLINE = (
    "null_profile", "distinct_profile", "top_values", "numeric_stats", "iqr_outliers", "casing_inconsistency",
    "duplicate_rows", "duplicate_rows_wide", "profile_dataset", "score_dataset", "dedup_lookup", "cross_dataset_fill",
    "annual_date_inference", "sequential_id_inference", "date_standardise", "find_correction_proposals",
    "apply_proposals", "row_context", "join_quality", "avg_claim_by_ncd", "claim_by_postcode", "premium_by_postcode",
    "insight_join", "dashboard",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "dataheal-bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    # Start the executors and load the code generator before the clock runs.
    queries["null_profile"](spark, sf_dir).collect()
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
