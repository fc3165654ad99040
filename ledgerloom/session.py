"""Session settings the metrics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Buckets are UTC hours, days, Monday weeks and months.
    "spark.sql.session.timeZone": "UTC",
    # Join and shuffle sizes are only known at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a join partition that one transaction fills, even where that costs
    # another shuffle of the joined rows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
