"""Seconds of the headline queries over one scale factor, as one line of JSON."""

from __future__ import annotations

import json
import os
import time

QUERIES = ("len_histogram", "symbol_totals", "kmer_counts", "interval_counts", "read_self_lookup", "exact_match", "hamming_match", "match_compete", "interval_union", "depth_per_base", "overlap_counts", "flay_divergence", "containment_join", "fasta_render")


def main() -> None:
    from pyspark.sql import SparkSession

    from strandline import catalog

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "4m"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in QUERIES:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
