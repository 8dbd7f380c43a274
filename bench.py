"""Times the headline queries. Prints one line of JSON.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8). Each query is written to the
noop sink, once to warm up and then BENCH_REPS times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

HEADLINE = ["validate_stateless", "sequencing", "ohlcv_bars", "bar_reconcile", "price_band", "validate_tallies", "bar_features", "robust_z", "cost_sweep", "arbitration_stats", "book_levels", "frame_rows"]


def noop(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf, cpus, reps = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tickforge.operators import generators, reports, validate
    from tickforge.plans import catalogue

    found = catalogue.queries()
    seconds = {}
    for name in HEADLINE:
        noop(found[name](spark, sf))
        seconds[name] = round(statistics.median(noop(found[name](spark, sf)) for _ in range(reps)), 4)
    events = spark.read.parquet(f"{sf}/events.parquet").count()

    # Throughput on a tape that is larger than the table: stateless and sequencing checks, then all of them. Exchanges are included.
    windows = int(os.environ.get("BENCH_WINDOWS", "50000"))
    tape = generators.synthetic_tape(spark, windows, 64).persist()
    records = tape.count()
    light = lambda: validate.with_sequencing(validate.with_stateless(tape)).selectExpr("stateless_flags + sequencing_flags as flags")
    rates = {}
    for name, make in (("light", lambda: reports.checksum(light())), ("full", lambda: reports.checksum(validate.validate(tape)))):
        noop(make())
        rates[name] = round(records / statistics.median(noop(make()) for _ in range(reps)))
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": sf, "cpus": int(cpus), "events": events, "tape_records": records, "tape_records_per_sec": rates}))


if __name__ == "__main__":
    main()
