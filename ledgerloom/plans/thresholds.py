"""Weekly reports of contracts above an activity threshold."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions.periods import Span, today, within
from ledgerloom.operators.combining import having_key
from ledgerloom.sources.ledger import Ledger


def _lookback(as_of: date | None, weeks: int) -> Span:
    return Span((as_of or today()) - timedelta(weeks=weeks), None, "week")


def _touched(
    ledger: Ledger, span: Span, excluded: Sequence[str], transactions: DataFrame
) -> DataFrame:
    """Distinct contracts per transaction of ``transactions``; unnamed ones drop out.

    Events are reduced to those transactions first, so only they are
    de-duplicated, in the partitions of that join.
    """
    events = (
        ledger.partner("native_event", span)
        .filter(~F.col("event_contract").isin(*excluded))
        .select("tx_id", "event_contract")
    )
    return having_key(events, transactions, "tx_id").distinct()


def _above(df: DataFrame, measure: str, threshold: int, *tie_break: str) -> DataFrame:
    return df.filter(F.col(measure) >= threshold).orderBy(
        F.col("date").desc(), F.col(measure).desc(), *tie_break
    )


def native_contracts_over_account_threshold(
    ledger: Ledger,
    *,
    as_of: date | None = None,
    threshold: int = C.ACCOUNT_THRESHOLD,
    weeks: int = C.THRESHOLD_WEEKS,
    excluded: Sequence[str] = C.INFRASTRUCTURE_CONTRACTS,
) -> DataFrame:
    """Native contracts with many distinct authorizers in a week."""
    span = _lookback(as_of, weeks)
    signers = (
        within(ledger.native_tx, span)
        .select("tx_id", span.bucket().alias("date"), F.explode("authorizers").alias("account"))
        .distinct()
    )
    users = (
        signers.join(_touched(ledger, span, excluded, signers), "tx_id")
        .groupBy("date", "event_contract")
        .agg(F.countDistinct("account").alias("unique_users"))
    )
    return _above(users, "unique_users", threshold, "event_contract")


def native_contracts_over_tx_threshold(
    ledger: Ledger,
    *,
    as_of: date | None = None,
    threshold: int = C.NATIVE_TX_THRESHOLD,
    weeks: int = C.THRESHOLD_WEEKS,
    excluded: Sequence[str] = C.INFRASTRUCTURE_CONTRACTS,
) -> DataFrame:
    """Native contracts with many distinct transactions in a week."""
    span = _lookback(as_of, weeks)
    transactions = (
        within(ledger.native_tx, span).select("tx_id", span.bucket().alias("date")).distinct()
    )
    # Both sides are distinct, so every joined row is another transaction.
    counts = (
        transactions.join(_touched(ledger, span, excluded, transactions), "tx_id")
        .groupBy("date", "event_contract")
        .agg(F.count(F.lit(1)).alias("total_transactions"))
    )
    return _above(counts, "total_transactions", threshold, "event_contract")


def _evm_over(
    ledger: Ledger, as_of: date | None, weeks: int, threshold: int, value: Column, measure: str
) -> DataFrame:
    """Listed EVM contracts above a threshold.

    Weekly counts are cut at the threshold before they meet the dimension.
    """
    span = _lookback(as_of, weeks)
    counts = (
        within(ledger.evm_tx, span)
        .filter(F.col("tx_succeeded"))
        .groupBy(span.bucket().alias("date"), F.col("to_address").alias("address"))
        .agg(value.alias(measure))
        .filter(F.col(measure) >= threshold)
    )
    name = F.col("name")
    identifier = F.when(
        name.isNotNull() & (name != ""),
        F.concat("address", F.lit(" ("), name, F.lit(")")),
    ).otherwise(F.col("address"))
    named = counts.join(ledger.evm_contract.select("address", "name").distinct(), "address")
    return _above(
        named.select("date", identifier.alias("contract_identifier"), measure),
        measure,
        threshold,
        "contract_identifier",
    )


def evm_contracts_over_account_threshold(
    ledger: Ledger,
    *,
    as_of: date | None = None,
    threshold: int = C.ACCOUNT_THRESHOLD,
    weeks: int = C.THRESHOLD_WEEKS,
) -> DataFrame:
    """Listed EVM contracts with many distinct senders in a week."""
    return _evm_over(
        ledger, as_of, weeks, threshold, F.countDistinct("from_address"), "active_accounts"
    )


def evm_contracts_over_tx_threshold(
    ledger: Ledger,
    *,
    as_of: date | None = None,
    threshold: int = C.EVM_TX_THRESHOLD,
    weeks: int = C.THRESHOLD_WEEKS,
) -> DataFrame:
    """Listed EVM contracts with many distinct transactions in a week."""
    return _evm_over(
        ledger, as_of, weeks, threshold, F.countDistinct("tx_hash"), "total_transactions"
    )
