"""Report periods: which rows a metric reads and how it buckets time.

Periods are resolved to plain dates in Python, so plans only ever see literal
bounds and the bounds reach the Parquet scan.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# period name -> (months back, days back, bucket grain); all_time starts at the
# ledger's first day instead.
_SERIES_PERIODS = {
    "all_time": (None, None, "month"),
    "last_year": (12, 0, "week"),
    "last_3_months": (3, 0, "week"),
    "last_month": (1, 0, "day"),
    "last_week": (0, 7, "day"),
    "last_24h": (0, 1, "hour"),
}

SERIES_PERIODS = tuple(_SERIES_PERIODS)
REPORT_PERIODS = tuple(p for p in _SERIES_PERIODS if p != "last_24h")


def today() -> date:
    """The current UTC date, the default ``as_of`` of every metric."""
    return datetime.now(timezone.utc).date()


def months_before(day: date, months: int) -> date:
    """``day`` minus whole months, clamped to the end of shorter months."""
    year, month0 = divmod(day.year * 12 + day.month - 1 - months, 12)
    last = calendar.monthrange(year, month0 + 1)[1]
    return date(year, month0 + 1, min(day.day, last))


def floor_date(day: date, grain: str) -> date:
    """First day of the bucket that holds the midnight of ``day``."""
    if grain == "month":
        return day.replace(day=1)
    if grain == "week":
        return day - timedelta(days=day.weekday())
    return day


def ceil_date(day: date, grain: str) -> date:
    """First bucket boundary at or after the midnight of ``day``."""
    floor = floor_date(day, grain)
    if floor == day:
        return day
    if grain == "month":
        return floor_date(floor + timedelta(days=31), "month")
    return floor + timedelta(days=7)


@dataclass(frozen=True)
class Span:
    """Half-open time range ``[start, end)`` with a bucket grain.

    A bound of ``None`` is open. Bounds are midnights, so they mean the same
    for timestamps and for a ``block_date`` partition column.
    """

    start: date | None = None
    end: date | None = None
    grain: str = "week"

    def bucket(self, column: str = "block_timestamp") -> Column:
        return F.date_trunc(self.grain, F.col(column))

    def until(self, end: date | None) -> "Span":
        return Span(self.start, end, self.grain)


def _start(period: str, as_of: date, genesis: date) -> date:
    months, days, _ = _SERIES_PERIODS[period]
    if months is None:
        return genesis
    return months_before(as_of, months) - timedelta(days=days)


def series_span(period: str, as_of: date, genesis: date) -> Span:
    """Range of a bucketed series. The bucket that is still open is left out."""
    if period not in _SERIES_PERIODS:
        raise ValueError(f"unknown period {period!r}; expected one of {SERIES_PERIODS}")
    grain = _SERIES_PERIODS[period][2]
    return Span(_start(period, as_of, genesis), floor_date(as_of, grain), grain)


def kpi_span(period: str, as_of: date, genesis: date) -> Span:
    """Range of a single-number metric: no end, and any other name is one day."""
    name = period if period in REPORT_PERIODS else "last_24h"
    return Span(_start(name, as_of, genesis), None, "day")


def report_start(period: str, as_of: date) -> date | None:
    """Start of a leaderboard, trend or growth report; ``all_time`` is open."""
    if period not in REPORT_PERIODS:
        raise ValueError(f"unknown period {period!r}; expected one of {REPORT_PERIODS}")
    return None if period == "all_time" else _start(period, as_of, as_of)


def midnight(day: date) -> Column:
    """Timestamp literal for the start of ``day`` in the session time zone."""
    return F.lit(day).cast("timestamp")


def within(df: DataFrame, span: Span, column: str = "block_timestamp") -> DataFrame:
    """Rows of ``df`` inside ``span``.

    When the table is laid out by ``block_date`` the same range is put on the
    partition column, so days outside it are never listed or read.
    """
    by_day = column == "block_timestamp" and "block_date" in df.columns
    if span.start is not None:
        df = df.filter(F.col(column) >= midnight(span.start))
        if by_day:
            df = df.filter(F.col("block_date") >= F.lit(span.start))
    if span.end is not None:
        df = df.filter(F.col(column) < midnight(span.end))
        if by_day:
            df = df.filter(F.col("block_date") < F.lit(span.end))
    return df
