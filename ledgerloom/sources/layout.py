"""Storage layout of the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_day(df: DataFrame, path: str, *, files_per_day: int) -> None:
    """Write a fact table partitioned by ``block_date``.

    Period filters then skip whole days (see ``functions.periods.within``). Rows
    of one day are spread over ``files_per_day`` tasks by a hash of the whole
    row, so neither a busy day nor a busy transaction is written by one task.
    Choose it so that a day's rows divided by it fit a task, about a file of
    some hundred megabytes each. Equal rows stay together.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_day))
    (
        df.withColumn("block_date", F.to_date("block_timestamp"))
        .repartition(F.col("block_date"), spread)
        .write.mode("error")
        .partitionBy("block_date")
        .parquet(path)
    )


def save_bucketed(df: DataFrame, table: str, *, key: str, buckets: int, path: str) -> None:
    """Save a table bucketed and sorted by its transaction key.

    Transactions and events (or logs) with the same bucket count join and
    de-duplicate on the key without a shuffle. A bucket is read by one task, so
    use :func:`write_by_day` where one key holds a large share of the rows.
    """
    (
        df.repartition(buckets, key)
        .write.mode("error")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table)
    )
