"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder with the Parquet tables (default sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_RUNS     timed runs per query, the median counts (default 3)
BENCH_QUERIES  comma-separated subset of query names (without it, periods are timed too)
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from checks.registry import CHECKS, SERIES
from checks.views import WORLDS, spark_ledger
from ledgerloom import METRICS, Ledger
from ledgerloom.sources import write_by_day

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


STORED = ("native_tx", "native_event", "native_actor", "evm_tx", "evm_log")
PERIODS = ("all_time", "last_24h")


def periods(spark: SparkSession) -> dict[str, dict[str, float]]:
    """Seconds per series and period over fact tables stored by day, one warm run each."""
    _, as_of, genesis = WORLDS["clicks"]
    source = spark_ledger(spark, SF_DIR, "clicks")
    with tempfile.TemporaryDirectory(prefix="ledgerloom-bench-") as root:
        logs = source.evm_log.join(source.evm_tx.select("tx_hash", "block_timestamp"), "tx_hash")
        for name in STORED:
            write_by_day(logs if name == "evm_log" else source[name], f"{root}/{name}", files_per_day=1)
        source.evm_contract.write.parquet(f"{root}/evm_contract")
        stored = Ledger.from_parquet(spark, root, genesis=genesis, shared_block_time=True)
        found = {}
        for period in PERIODS:
            for name in SERIES:
                for _ in range(2):
                    started = time.perf_counter()
                    df = METRICS[name](stored, period=period, as_of=as_of)
                    df.write.format("noop").mode("overwrite").save()
                    took = time.perf_counter() - started
                found.setdefault(period, {})[name] = round(took, 4)
    return found


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("ledgerloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else [name for name in CHECKS if "__" not in name]

    def run(name: str) -> float:
        started = time.perf_counter()
        CHECKS[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    timings = {}
    for name in names:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(RUNS)), 4)
    bounded = periods(spark) if chosen is None else {}
    print(
        json.dumps(
            {
                "metric": "total seconds over all metrics, median of runs",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "periods": bounded,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
