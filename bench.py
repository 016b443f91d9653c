"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trackwright.plans import QUERIES  # noqa: E402
from trackwright.session import drop_scratch, local_session  # noqa: E402

HEADLINE = [
    "match_summary", "smooth_speed", "dist_to_speed", "ema_speed", "nearest_fill", "hampel_flag", "rally_sections", "deadtime_pipeline",
    "section_frame_join", "bbox_iou_pairs", "nms_greedy", "yolo_filter_topn", "homography_apply", "mutual_nearest", "gt_match_ap", "ball_tracker",
]
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + REPEATS):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            drop_scratch(spark)
        seconds[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_median_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
