"""Batch analytics over the tables of a two-ledger blockchain, on Spark."""

from ledgerloom.plans import METRICS
from ledgerloom.session import configure
from ledgerloom.sources import Ledger

__all__ = ["METRICS", "Ledger", "configure"]
