"""Time the headline queries: python bench.py (BENCH_SF_DIR, BENCH_CPUS); prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nightjar import catalog  # noqa: E402
from nightjar.session import build_session  # noqa: E402

HEADLINE = [
    "night_summary", "interval_labels", "contextual_features", "desaturation_events", "hypoxic_burden", "eeg_band_power",
    "auc_heavy_ties", "auc_and_average_precision", "calibration_equal_width", "rate_agreement", "subject_bootstrap", "delong",
    "group_split", "scored_epochs", "harrell_concordance", "uno_concordance", "cumulative_dynamic_auc", "brier_over_time",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", cpus)
    catalog.load()
    catalog.QUERIES["sleep_epochs"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM side
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
