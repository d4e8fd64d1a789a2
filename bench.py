"""Times the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinespark.plans import registry  # noqa: E402
from kinespark.session import local_session  # noqa: E402

HEADLINE = [
    "velocity_fit", "acceleration_fit", "pca_axis_speed", "gradient_velocity", "moving_average5", "middle_window_stats", "tracking_gate", "mask_reasons_decision", "component_scores", "qmask_min",
    "video_scores", "metric_summary", "model_macro_summary", "sensitivity_grid", "rank_stability", "common_cohort", "track_normalize", "steady_velocity", "event_estimates", "golden_estimates",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries, took = registry.queries(), {}
    registry.queries()["velocity_fit"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
