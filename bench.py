"""Benchmark: run the headline analyses on $BENCH_SF_DIR (default sf0.1) with
local[$BENCH_CPUS]; print one JSON line.

Each query runs from the parquet files and is fully executed into Spark's
no-op sink (nothing is collected); the time per query is the median of
$BENCH_RUNS warm runs (after one warm-up run, which also builds the frames'
plans once per data folder). The headline value is the sum of these medians.

A second section (BENCH_SERVED=1, default) times the same analyses against
frames extracted once and checkpointed, the way the source application
serves every request from frames loaded at start-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stagelight.plans.catalog import QUERIES, Workspace, run_on  # noqa: E402
from stagelight.session import build_session  # noqa: E402

HEADLINE = [
    "load_transactions", "load_teacher_performance", "kpi_summary", "monthly_revenue_growth",
    "booking_heatmap", "booking_heatmap_wide", "filter_combined", "age_histogram",
    "demo_gender", "demo_age_course", "teacher_top5", "teacher_sales_ranked",
    "audience_heatmap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    keys = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = build_session(f"local[{cpus}]", app_name="stagelight-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    times, shape = {}, {}
    tracker = spark.sparkContext.statusTracker()
    for key in keys:
        fn = QUERIES[key]
        samples = []
        for i in range(runs + 1):
            group = f"bench-{key}-{i}"
            spark.sparkContext.setJobGroup(group, key)
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:  # first run warms the JVM and file caches
                samples.append(time.perf_counter() - t0)
        jobs = tracker.getJobIdsForGroup(group)
        stages = sum(len(info.stageIds) for info in map(tracker.getJobInfo, jobs) if info)
        times[key] = round(statistics.median(samples), 4)
        shape[key] = {"jobs": len(jobs), "stages": stages}
    served = {}
    if os.environ.get("BENCH_SERVED", "1") == "1":
        # The source application's shape: extract the frames once, then answer
        # every analysis from them. Frames are checkpointed (reliably) into the
        # session's spark.checkpoint.dir.
        t0 = time.perf_counter()
        ws = Workspace.from_tpch(spark, sf_dir).materialize()
        served["materialize_frames"] = round(time.perf_counter() - t0, 4)
        for key in keys:
            samples = []
            for i in range(runs + 1):
                t0 = time.perf_counter()
                run_on(ws, key).write.format("noop").mode("overwrite").save()
                if i:
                    samples.append(time.perf_counter() - t0)
            served[key] = round(statistics.median(samples), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times, "sf": sf,
                      "served_from_materialized_frames": served,
                      "spark_jobs_and_stages": shape,
                      "config": {"master": f"local[{cpus}]", "spark": spark.version,
                                 "shuffle_partitions": cpus, "runs": runs}}))
    spark.stop()


if __name__ == "__main__":
    main()
