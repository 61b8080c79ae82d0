"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all)
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a3_dissected_ingest", "b3_drop_duplicates", "b4_capture_clean", "c1_is_private_ip", "d2_ip_statistics", "d4_traffic_summary",
    "e1_minute_timeline", "e6_bandwidth_report", "f4_protocol_report", "f6_protocol_profile", "g7_health_report", "h6_quality_report",
    "i10_bottleneck_report", "j1_ddos_window", "j14_scan_profile", "j25_bruteforce_alerts", "k1_detection_run", "k2_cooldown_6h",
    "k12_alert_summary", "l2_retention", "l4_executive_summary", "m1_engineered_columns", "m4_rolling_statistics", "m9_feature_matrix",
    "n1_weak_labels", "n9_standard_scaling", "o2_forest_scores", "o7_classifier_metrics", "o7_one_vs_rest_auc",
    "p1_live_bandwidth", "p4_streaming_portscan", "p5_streaming_cooldown",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    only = sys.argv[1:]
    from packetloom.plans.catalogue import load_all
    from packetloom.session import build_session

    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        # the bench tables are a few MB: let AQE keep partitions small enough to use all cores
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k"})
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    names = [n for n in HEADLINE if not only or n in only]
    # start the JVM's compiler and the Python workers before the clock runs
    entries["f4_protocol_report"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        entries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    with contextlib.suppress(Exception):
        spark.stop()


if __name__ == "__main__":
    main()
