"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallyforge.plans import contest

HEADLINE = ["batch_metrics", "performance_by_k", "performance_across_k", "seat_counts", "mirrored_pairs", "length_stats", "margin_stats", "rare_event_rates", "lag_autocorr_strategy", "lag_autocorr_matchup", "lag_autocorr_events", "root_combined_by_k", "half_drift", "matched_convergence", "bootstrap_ranks", "pareto_front", "h2h_inference", "rating_percentile"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    contest.QUERIES["game_summary"](spark, folder).collect()  # starts the JVM's compilers and fills the file cache
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        contest.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
