"""Accounts seen on either ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.periods import Span, within
from ledgerloom.operators.combining import stack
from ledgerloom.sources.ledger import Ledger


def native_accounts(ledger: Ledger, span: Span, *extra: Column) -> DataFrame:
    """One ``account`` row per entry of ``actors``; empty lists give none."""
    return within(ledger.native_actor, span).select(*extra, F.explode("actors").alias("account"))


def evm_accounts(ledger: Ledger, span: Span, *extra: Column) -> DataFrame:
    return within(ledger.evm_tx, span).select(*extra, F.col("from_address").alias("account"))


def all_accounts(ledger: Ledger, span: Span, *extra: Column) -> DataFrame:
    return stack(native_accounts(ledger, span, *extra), evm_accounts(ledger, span, *extra))
