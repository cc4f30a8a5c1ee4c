"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["column_profile", "numeric_summary", "distinct_profile", "top_values", "value_patterns", "duplicate_rows",
            "null_profile", "fk_integrity_report", "monthly_trend", "table_profile", "infer_fks", "lineage_tags",
            "parse_responses", "prompt_batches"]


def main() -> None:
    from pyspark.sql import SparkSession

    from checks import queries as Q
    from tabscope.sources import scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine and compile the common code paths before anything is timed
    Q.QUERIES["column_profile"](spark, sf_dir).collect()
    seconds = {}
    for name in HEADLINE:
        Q.forget()
        start = time.perf_counter()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    Q.forget()
    scratch.clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
