"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tracework import catalogue

HEADLINE = (
    "gap_sessions bracket_pairs bracket_segments segment_event_counts max_overlap_match bijection_counts boundary_prf "
    "asof_neighbours v_measure ks_two_sample process_profile threshold_route text_ids density_features "
    "windowdiff grid_units non_max_suppression permutation_test segment_labels delivered_segments case_anchors log_flatten label_profile"
).split()


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = 1e9
        for _ in range(2):  # the first run compiles
            began = time.time()
            catalogue.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
