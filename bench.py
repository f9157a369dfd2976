"""Times the headline queries over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import glob
import json
import os
import statistics
import time

import duckdb
from pyspark.sql import SparkSession

from tessera.plans import registry

HEADLINES = ["bm25_topk", "grep_topk", "rrf_fusion", "dense_topk", "manifest_diff", "upsert_last_wins", "soft_delete_facts", "line_chunks", "gap_ranges", "heading_sections",
             "edge_histogram", "traverse_depth3", "impact", "entity_resolution", "range_overlap_join", "asof_first_after", "rate_limit_window", "tumbling", "session_windows", "session_replay"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(3):  # the first warms up
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    beside = {}
    con = duckdb.connect(config={"threads": int(cpus)})
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    for name in HEADLINES:  # the same rows from the same files by SQL on one machine
        began = time.perf_counter()
        con.execute(registry.ORACLE_SQL[name]).fetchall()
        beside[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "duckdb": beside, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
