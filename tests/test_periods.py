from datetime import date

import pytest

from ledgerloom.functions.periods import (
    ceil_date,
    floor_date,
    kpi_span,
    months_before,
    report_start,
    series_span,
)

GENESIS = date(2020, 1, 1)


def test_month_end_is_clamped():
    assert months_before(date(2024, 3, 31), 1) == date(2024, 2, 29)
    assert months_before(date(2024, 2, 29), 12) == date(2023, 2, 28)
    assert months_before(date(2024, 1, 15), 3) == date(2023, 10, 15)
    assert series_span("last_month", date(2024, 3, 31), GENESIS).start == date(2024, 2, 29)


@pytest.mark.parametrize(
    "period,start,end,grain",
    [
        ("all_time", date(2020, 1, 1), date(2024, 5, 1), "month"),
        ("last_year", date(2023, 5, 16), date(2024, 5, 13), "week"),
        ("last_3_months", date(2024, 2, 16), date(2024, 5, 13), "week"),
        ("last_month", date(2024, 4, 16), date(2024, 5, 16), "day"),
        ("last_week", date(2024, 5, 9), date(2024, 5, 16), "day"),
        ("last_24h", date(2024, 5, 15), date(2024, 5, 16), "hour"),
    ],
)
def test_series_spans(period, start, end, grain):
    span = series_span(period, date(2024, 5, 16), GENESIS)
    assert (span.start, span.end, span.grain) == (start, end, grain)


def test_unknown_periods():
    with pytest.raises(ValueError):
        series_span("yesterday", date(2024, 5, 16), GENESIS)
    with pytest.raises(ValueError):
        report_start("last_24h", date(2024, 5, 16))
    # Single-number metrics fall back to one day.
    assert kpi_span("yesterday", date(2024, 5, 16), GENESIS).start == date(2024, 5, 15)
    assert kpi_span("last_24h", date(2024, 5, 16), GENESIS).end is None


def test_reports_have_no_genesis():
    assert report_start("all_time", date(2024, 5, 16)) is None
    assert report_start("last_week", date(2024, 5, 16)) == date(2024, 5, 9)


def test_bucket_boundaries():
    assert floor_date(date(2024, 5, 16), "week") == date(2024, 5, 13)
    assert ceil_date(date(2024, 5, 13), "week") == date(2024, 5, 13)
    assert ceil_date(date(2024, 5, 14), "week") == date(2024, 5, 20)
    assert ceil_date(date(2024, 12, 2), "month") == date(2025, 1, 1)
    assert ceil_date(date(2024, 5, 14), "hour") == date(2024, 5, 14)
