"""Single-number metrics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions.periods import Span, kpi_span, midnight, series_span, today, within
from ledgerloom.operators.accounts import all_accounts, evm_accounts, native_accounts
from ledgerloom.operators.combining import having_key, merge_totals, stack
from ledgerloom.operators.deployments import evm_deployments
from ledgerloom.sources.ledger import Ledger
from ledgerloom.sources.state import ACCOUNT_KINDS


def evm_transactions_kpi(
    ledger: Ledger, *, period: str = "last_24h", as_of: date | None = None
) -> DataFrame:
    """Distinct EVM transactions since the start of the period."""
    span = kpi_span(period, as_of or today(), ledger.genesis)
    return within(ledger.evm_tx, span).agg(F.countDistinct("tx_hash").alias("total_transactions"))


def transactions_by_ledger_kpi(
    ledger: Ledger, *, period: str = "last_24h", as_of: date | None = None
) -> DataFrame:
    """Distinct transactions of each ledger and their sum."""
    span = kpi_span(period, as_of or today(), ledger.genesis)
    totals = merge_totals(
        within(ledger.native_tx, span).agg(F.countDistinct("tx_id").alias(C.NATIVE_LABEL)),
        within(ledger.evm_tx, span).agg(F.countDistinct("tx_hash").alias(C.EVM_LABEL)),
    )
    return totals.withColumn(
        "total_transactions", F.col(C.NATIVE_LABEL) + F.col(C.EVM_LABEL)
    )


def active_addresses_kpi(
    ledger: Ledger, *, period: str = "last_24h", as_of: date | None = None
) -> DataFrame:
    """Distinct accounts per ledger, summed; users of both count twice."""
    span = kpi_span(period, as_of or today(), ledger.genesis)
    per_ledger = (
        accounts.agg(F.countDistinct("account").alias("n"))
        for accounts in (native_accounts(ledger, span), evm_accounts(ledger, span))
    )
    return stack(*per_ledger).agg(F.sum("n").alias("total_active_addresses"))


def new_accounts_kpi(
    ledger: Ledger, *, period: str = "last_24h", as_of: date | None = None
) -> DataFrame:
    """Distinct accounts of the closed buckets of the period, over both ledgers."""
    span = series_span(period, as_of or today(), ledger.genesis)
    return all_accounts(ledger, span).agg(
        F.countDistinct("account").alias("total_new_accounts_last_24h")
    )


def first_ever_accounts_kpi(
    ledger: Ledger, *, period: str = "last_24h", as_of: date | None = None
) -> DataFrame:
    """Accounts of the period that their ledger had never shown before it.

    The period includes the midnight of ``as_of``. History is reduced to the
    accounts of the period before it is looked at; where the ledger has a
    first-seen state, that is read instead and history is not.
    """
    as_of = as_of or today()
    start = kpi_span(period, as_of, ledger.genesis).start
    seen = F.col("block_timestamp")
    if ledger.first_seen is not None:
        first = F.col("first").between(midnight(start), midnight(as_of))
        return stack(
            *(
                ledger.first_seen.seen(kind, Span(None, as_of + timedelta(days=1)))
                .filter(first & F.col("account").isNotNull())
                .agg(F.count(F.lit(1)).alias("n"))
                for kind in ACCOUNT_KINDS.values()
            )
        ).agg(F.sum("n").alias("total_new_accounts_last_24h"))
    period_span, history = Span(start, as_of + timedelta(days=1)), Span(None, start)
    per_ledger = []
    for accounts in (native_accounts, evm_accounts):
        recent = (
            accounts(ledger, period_span, seen)
            .filter((seen <= midnight(as_of)) & F.col("account").isNotNull())
            .select("account")
            .distinct()
        )
        earlier = having_key(accounts(ledger, history), recent, "account").distinct()
        new = recent.join(earlier, "account", "left_anti")
        per_ledger.append(new.agg(F.count(F.lit(1)).alias("n")))
    return stack(*per_ledger).agg(F.sum("n").alias("total_new_accounts_last_24h"))


def native_deployers_kpi(
    ledger: Ledger,
    *,
    period: str = "last_24h",
    as_of: date | None = None,
    event_type: str = C.CONTRACT_ADDED_EVENT,
) -> DataFrame:
    """Distinct first authorizers of transactions that added a contract."""
    span = kpi_span(period, as_of or today(), ledger.genesis)
    added = within(ledger.native_event, span).filter(F.col("event_type") == event_type)
    deployer = F.get(F.col("authorizers"), F.lit(0))
    return having_key(ledger.partner("native_tx", span), added, "tx_id").agg(
        F.countDistinct(deployer).alias("total_cadence_deployers")
    )


def native_deployers_by_actor_kpi(
    ledger: Ledger, *, event_type: str = C.CONTRACT_ADDED_EVENT
) -> DataFrame:
    """Distinct actors of all transactions that ever added a contract."""
    added = ledger.native_event.filter(F.col("event_type") == event_type)
    return (
        having_key(ledger.native_actor, added, "tx_id")
        .select(F.explode("actors").alias("account"))
        .agg(F.countDistinct("account").alias("total_cadence_deployers"))
    )


def contract_deployments_kpi(
    ledger: Ledger,
    *,
    period: str = "last_24h",
    as_of: date | None = None,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """Distinct native contracts with events and distinct EVM deployments."""
    span = kpi_span(period, as_of or today(), ledger.genesis)
    return merge_totals(
        within(ledger.native_event, span).agg(
            F.countDistinct("event_contract").alias("total_new_cadence_contracts")
        ),
        evm_deployments(ledger, span, topic=topic, signatures=signatures).agg(
            F.countDistinct("contract").alias("total_new_evm_contracts")
        ),
    )
