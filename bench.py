"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Names of queries as arguments pick some."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oligoframe import Filter, generate, validate
from oligoframe.operators.similarity import self_join
from oligoframe.queries import QUERIES, library

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
F0 = Filter()


def generated(count: int, length: int):
    return lambda spark, d: generate(spark, count, length, F0, "bench").sequences


def validated(count: int, length: int):
    """Validation of a library that has no violation, so that every pair is looked at."""

    def run(spark, d):
        path = f"/tmp/oligoframe-bench-{count}-{length}"
        if not Path(path).exists():
            generate(spark, count, length, F0, "bench").sequences.write.parquet(path)
            return None
        result = validate(spark.read.parquet(path).select("id", "seq"), F0)
        assert result.overall_valid
        return None

    return run


def wanted() -> dict:
    out = {
        "generate_1k_10bp": generated(1_000, 10),
        "generate_10k_12bp": generated(10_000, 12),
        "generate_100k_14bp": generated(100_000, 14),
        "validate_10k_12bp": validated(10_000, 12),
        "validate_100k_14bp": validated(100_000, 14),
        "hamming_violations_16bp": lambda spark, d: self_join(library(spark, d, 16), 3),
        "validation_summary": QUERIES["validation_summary"],
        "bio_violations": QUERIES["bio_violations"],
        "levenshtein_violations": QUERIES["levenshtein_violations"],
        "similarity_anti_join": QUERIES["similarity_anti_join"],
        "greedy_select": QUERIES["greedy_select"],
    }
    return {k: v for k, v in out.items() if not sys.argv[1:] or k in sys.argv[1:]}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).agg(F.sum("id")).collect()
    times = {}
    for name, query in wanted().items():
        if name.startswith("validate_"):
            query(spark, SF_DIR)  # makes the library if it isn't there
        began = time.time()
        df = query(spark, SF_DIR)
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "total wall time", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
