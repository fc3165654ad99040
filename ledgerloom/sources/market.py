"""Market-chart snapshots: JSON documents with ``[epoch ms, value]`` series."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.periods import Span, within
from ledgerloom.sources.schemas import MARKET_CHART

SERIES = ("prices", "market_caps", "total_volumes")


def read_market_chart(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, one JSON document per file."""
    return spark.read.schema(MARKET_CHART).option("multiLine", True).json(path)


def market_points(chart: DataFrame, *, days: int, as_of: date) -> DataFrame:
    """``(series, date, value)`` points of all series of the last ``days`` days.

    The range is what a request for ``days`` days made on ``as_of`` returns:
    it reaches into ``as_of`` itself, for the latest quote of that day.
    """

    def labelled(name: str):
        return F.transform(
            F.coalesce(F.col(f"data.{name}"), F.array()),
            lambda pair: F.struct(
                F.lit(name).alias("series"),
                F.timestamp_millis(F.get(pair, F.lit(0)).cast("bigint")).alias("date"),
                F.get(pair, F.lit(1)).alias("value"),
            ),
        )

    points = chart.select(F.inline(F.concat(*(labelled(name) for name in SERIES))))
    span = Span(as_of - timedelta(days=days), as_of + timedelta(days=1))
    return within(points, span, "date")
