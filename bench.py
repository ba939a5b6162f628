"""Headline queries, timed end to end into a no-op sink. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["flagship_mask", "scan_documents", "mask_documents", "pseudonymize_documents", "hits_table_documents",
            "preflight_documents", "scan_pages", "scan_conversations", "scan_notes", "policy_ai_prompt",
            "policy_block_rates", "sanitize_record_mask", "profile_slate_crm", "column_profile", "metrics",
            "stats_windowed"]


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.queries import QUERIES
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flagship_mask"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
