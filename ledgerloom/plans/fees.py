"""Fee series and fee totals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions.measures import non_zero, running, trailing_quotient
from ledgerloom.functions.periods import kpi_span, series_span, today, within
from ledgerloom.operators.combining import having_key, stack
from ledgerloom.sources.ledger import Ledger


def _is_fee(contract: str, event: str) -> Column:
    return (F.col("event_contract") == contract) & (F.col("event_type") == event)


# Fees have eight decimals on the ledger. Sums of them are exact, so they do not
# depend on the order of addition and equal ones are equal.
# The product with a number of copies has 38 digits, all of which Spark keeps.
_EXACT, _COPIES = "decimal(24,8)", "decimal(13,0)"


def _exact(amount: str) -> Column:
    return F.col(amount).cast(_EXACT)


def _mean(fees: Column, rows: Column) -> Column:
    return fees.cast("double") / non_zero(rows)


def _paid(events: DataFrame, *keys) -> DataFrame:
    """Fee events summed per transaction before they meet the transactions."""
    return events.groupBy("tx_id", *keys).agg(
        F.sum(_exact("event_amount")).cast(_EXACT).alias("amount"),
        F.count("event_amount").alias("payments"),
    )


def _copies(transactions: DataFrame) -> DataFrame:
    """How many rows a transaction has; each one repeats its fee events."""
    return transactions.groupBy("tx_id").agg(F.count(F.lit(1)).alias("copies"))


def _fee_measures() -> tuple[Column, Column]:
    """Sum and mean over the rows of a transaction-event join.

    Both sides are pre-aggregated, so a joined pair stands for
    ``payments * copies`` rows that are never produced.
    """
    fees = F.sum(F.col("amount") * F.col("copies").cast(_COPIES))
    rows = F.sum(F.col("payments") * F.col("copies"))
    return fees.alias("fees"), _mean(fees, rows).alias("mean")


def _evm_measures() -> tuple[Column, Column]:
    fees = F.sum(_exact("tx_fee"))
    return fees.alias("fees"), _mean(fees, F.count("tx_fee")).alias("mean")


def fees_over_time(
    ledger: Ledger,
    *,
    period: str = "last_year",
    as_of: date | None = None,
    fee_contract: str = C.FEE_CONTRACT,
    fee_event: str = C.FEE_EVENT,
) -> DataFrame:
    """Fees of both ledgers per bucket, with running total and trailing mean.

    ``avg_tx_flow_fee`` is the plain mean of the ledgers' means. Ledgers with
    the same sum and mean in a bucket count once. A native fee needs a
    transaction row with its id. ``avg_28d_flow_fees`` spans four buckets.
    """
    span = series_span(period, as_of or today(), ledger.genesis)
    bucket = span.bucket().alias("date")
    evm = (
        within(ledger.evm_tx, span)
        .groupBy(bucket)
        .agg(*_evm_measures())
    )
    paid = _paid(within(ledger.native_event.filter(_is_fee(fee_contract, fee_event)), span), bucket)
    native = (
        paid.join(_copies(having_key(ledger.partner("native_tx", span), paid, "tx_id")), "tx_id")
        .groupBy("date")
        .agg(*_fee_measures())
    )
    per_bucket = (
        stack(evm, native)
        .distinct()
        .groupBy("date")
        .agg(F.sum("fees").alias("flow_fees"), F.avg("mean").alias("avg_tx_flow_fee"))
    )
    fees = F.col("flow_fees")
    return per_bucket.select(
        "date",
        fees.cast("double").alias("flow_fees"),
        "avg_tx_flow_fee",
        running(fees, "date").cast("double").alias("total_flow_fees"),
        trailing_quotient(fees, "date").alias("avg_28d_flow_fees"),
    ).orderBy(F.col("date").desc())


def total_fees_kpi(
    ledger: Ledger,
    *,
    period: str = "last_24h",
    as_of: date | None = None,
    fee_contract: str = C.FEE_CONTRACT,
    fee_event: str = C.FEE_EVENT,
) -> DataFrame:
    """Total fees and the plain mean of the two ledgers' mean fees.

    The period is that of the transactions, also for native fee events.
    """
    span = kpi_span(period, as_of or today(), ledger.genesis)
    evm = within(ledger.evm_tx, span).agg(*_evm_measures())
    events = ledger.partner("native_event", span).filter(_is_fee(fee_contract, fee_event))
    copies = _copies(within(ledger.native_tx, span))
    native = (
        _paid(having_key(events, copies, "tx_id")).join(copies, "tx_id").agg(*_fee_measures())
    )
    return stack(evm, native).agg(
        F.sum("fees").cast("double").alias("total_fees_flow"),
        F.avg("mean").alias("avg_tx_fee_flow"),
    )
