"""Headline timings: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line.

Each query is planned and run once after a short warm-up on a few rows, into a sink that keeps nothing.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from veilframe.config import ScanConfig
from veilframe.operators.scan import scan
from veilframe.plans.queries import NET, QUERIES, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("counts_by_source", "type_counts_by_source_full", "scan_all_types", "mask_documents", "restore_documents",
            "session_summary", "guard_actions", "generated_scan", "check_digits")


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    n_docs, n_chars = docs.selectExpr("count(*)", "sum(length(text))").first()
    sink(scan(docs.limit(50), "text"))
    timings = {}

    def timed(name, run):
        began = time.time()
        sink(run())
        timings[name] = round(time.time() - began, 3)

    timed("scan_default_types", lambda: scan(docs, "text", ScanConfig()))
    timed("scan_email_ip", lambda: scan(docs, "text", NET))
    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, SF_DIR))
    scan_sec = timings["scan_default_types"]
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS), "documents": n_docs,
        "scan_docs_per_sec": round(n_docs / scan_sec, 1), "scan_chars_per_sec": round(n_chars / scan_sec),
    }))


if __name__ == "__main__":
    main()
