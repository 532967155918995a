"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and then RUNS times to a no-op sink; the
median counts. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

import marquee.plans  # noqa: F401
from marquee.plans.registry import QUERIES
from marquee.ship import ship

HEADLINE = (
    "q1_health", "q2_source_quality", "q4_film_search", "q4_genre_decade", "q5_entry_points", "q6_compare_signals", "q6_compare_pair", "q7_lineage_edges", "q7_lineage_one", "q8_film_detail", "q8_film_one", "q9_filmography", "q10_person_graph", "q11_similar_films",
    "ag4_fold", "jn15_reconcile_status", "jn21_phrase_match", "wn2_exact_dedup", "wn3_stratified_shelf", "up1_update_or_insert", "tx1_strip_markup", "tx8_chunks", "val_constraints",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    spark.sparkContext.setCheckpointDir(f"/tmp/bench-checkpoint-{os.getpid()}")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:]), 4)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
