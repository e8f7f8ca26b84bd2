"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then `BENCH_RUNS` times (3); the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)

HEADLINE = ["detect_fires", "detection_scores", "threshold_sweep", "kwindow_policy_grid", "energy_islands", "dominant_run", "sliding_rms", "hash_split", "unknown_quota_mix", "percentile_report", "content_tokens", "phrase_match", "nearest_neighbor", "utterance_sessions"]


def main() -> None:
    folder, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tidewell.plans import catalogue

    queries = {n: catalogue.QUERIES[n] for n in HEADLINE}
    try:
        from tidewell.llm import registry

        queries |= {n: f for n, f in registry.QUERIES.items() if n.startswith("op")}
    except ImportError:
        pass
    took = {}
    for name, q in queries.items():
        times = []
        for _ in range(runs + 1):
            began = time.time()
            q(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
            if times[0] > 60:  # long queries aren't repeated
                break
        took[name] = round(median(times[1:] or times), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
