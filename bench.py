"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from pagewright import catalog

HEADLINE = ["doc_quality", "continued_tables", "split_row_merge", "join_wrapped", "cjk_collapse", "noise_rows", "table_shape", "findings", "hf_strip", "reading_order", "glyph_rows", "event_upsert", "golden_metrics", "html_text"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took, rows = catalog.queries(), {}, {}
    queries[HEADLINE[0]](spark, sf).count()  # start-up is not the queries' time
    for name in HEADLINE:
        began = time.perf_counter()
        df = queries[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
