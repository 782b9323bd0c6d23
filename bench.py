"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession
from veilframe.plans.catalog import QUERIES

HEADLINES = [
    "q01_detect_counts", "q02_detect_by_lang_source", "q03_redact_text", "q04_outbound_scan", "q05_pages_pii", "d03_conversations_scan", "b01_verhoeff", "b07_luhn", "b11_iban97", "q13_iou_pairs",
    "h02_dedup_detections", "h03_dedup_boxes", "h13_suppression", "q16_reading_order", "q18_budget_cap", "q20_coverage_cells", "q22_top3_area", "q23_line_grouping", "q25_attest", "q27_verdict_chain", "q31_mutation_sessions", "q33_mask_area",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(max(8, int(cpus)))).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):  # the first warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else sf_dir}))


if __name__ == "__main__":
    main()
