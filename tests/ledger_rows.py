"""Small helpers of the ledger tests."""

from datetime import datetime


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
