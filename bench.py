"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The reference's main paths: window state, quality, labels, joins with statistics, trailing features, profile.
HEADLINE = (
    "global_state",
    "host_topk",
    "edge_semi",
    "delta_host",
    "scaler_apply",
    "rule_classify",
    "repair",
    "quality_metrics",
    "schedule_label",
    "interval_join",
    "packet_stats",
    "ordered_merge",
    "xf_scan_rate",
    "xf_grouped",
    "describe",
    "corr_report",
    "bag_similarity",
)
#: Timed too, but not part of the total, which stays comparable.
FURTHER = ("xf_entropy", "xf_sequentiality", "xf_hot_source", "total_sort", "packet_profile", "job_clean", "job_states", "corr_wide", "interval_classes", "schedule_table", "flow_assembly", "capture_by_ranges")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from netquarry.plans import registry
    from netquarry.session import build_session

    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # the first job starts the engine
    took = {}
    for name in HEADLINE + FURTHER:
        times = []
        for _ in range(2):  # the second run has its code compiled
            began = time.perf_counter()
            made[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times), 3)
    with contextlib.suppress(OSError):
        sys.stdout.flush()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
