"""Contract and deployer series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions.measures import running, trailing_mean
from ledgerloom.functions.periods import (
    Span,
    midnight,
    months_before,
    series_span,
    today,
    within,
)
from ledgerloom.operators.combining import align, stack
from ledgerloom.operators.deployments import evm_contracts_or_transactions, evm_deployments
from ledgerloom.operators.ranking import first_seen
from ledgerloom.sources.ledger import Ledger
from ledgerloom.sources.state import CONTRACT_KIND, DEPLOYMENT_KIND


def _is_coa(prefix: str) -> Column:
    """NULL creators are neither COA nor non-COA."""
    return F.col("creator").startswith(prefix)


def _native_contracts(ledger: Ledger, span: Span) -> DataFrame:
    """Distinct native contracts with events per bucket."""
    return (
        within(ledger.native_event, span)
        .groupBy(span.bucket().alias("day"))
        .agg(F.countDistinct("event_contract").alias("native"))
    )


def _native_debuts(ledger: Ledger, span: Span) -> DataFrame:
    """Native contracts and their first event inside ``span``, from the ledger's state where it has one."""
    if ledger.first_seen is not None:
        return ledger.first_seen.seen(CONTRACT_KIND, span).withColumnRenamed("first", "debut")
    events = within(ledger.native_event, span)
    return first_seen(events, "event_contract", F.col("block_timestamp"), "debut")


def contract_deployments_split(
    ledger: Ledger,
    *,
    period: str = "last_year",
    as_of: date | None = None,
    coa_prefix: str = C.COA_PREFIX,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """New contracts per bucket: native, EVM by COA creators, EVM by others.

    A native contract counts in the bucket of its first event in the period; an
    EVM contract counts in every bucket with a deployment of it.
    """
    span = series_span(period, as_of or today(), ledger.genesis)
    debuts = _native_debuts(ledger, span)
    native = debuts.groupBy(span.bucket("debut").alias("day")).agg(
        F.count("event_contract").alias("native")
    )
    contract = F.col("contract")
    evm = (
        evm_deployments(ledger, span, topic=topic, signatures=signatures)
        .select(F.col("bucket").alias("day"), _is_coa(coa_prefix).alias("coa"), "contract")
        .distinct()
        .groupBy("day")
        .agg(
            F.count(F.when(F.col("coa"), contract)).alias("coa"),
            F.count(F.when(~F.col("coa"), contract)).alias("non_coa"),
        )
    )
    native_n, coa, non_coa = F.col("native"), F.col("coa"), F.col("non_coa")
    full = native_n + non_coa + coa
    return (
        align(native, evm, "day")
        .select(
            "day",
            native_n.alias("new_cadence_contracts"),
            running(native_n, "day").alias("total_cadence_contracts"),
            non_coa.alias("new_non_coa_evm_contracts"),
            running(non_coa, "day").alias("total_non_coa_evm_contracts"),
            coa.alias("new_coa_contracts"),
            running(coa, "day").alias("total_coa_contracts"),
            full.alias("full_contracts"),
            running(full, "day").alias("total_full_contracts"),
            trailing_mean(full, "day").alias("rolling_avg_new_contracts"),
        )
        .orderBy(F.col("day").desc())
    )


def active_contracts_by_ledger(
    ledger: Ledger,
    *,
    period: str = "last_year",
    as_of: date | None = None,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """Contracts active per bucket, one row per ledger, with running sums.

    The running sum adds up buckets, so a contract counts once per bucket.
    """
    span = series_span(period, as_of or today(), ledger.genesis)
    native = _native_contracts(ledger, span).select(
        "day", F.lit(C.NATIVE_LABEL).alias("type"), F.col("native").alias("new_contracts")
    )
    evm = (
        evm_deployments(ledger, span, topic=topic, signatures=signatures)
        .groupBy(F.col("bucket").alias("day"), F.lit(C.EVM_LABEL).alias("type"))
        .agg(F.countDistinct("contract").alias("new_contracts"))
    )
    count = F.col("new_contracts")
    return (
        stack(native, evm)
        .withColumn("total_contracts", running(count, "day", ["type"]))
        .orderBy(F.col("day").desc(), "type")
    )


def contract_counts_over_time(
    ledger: Ledger,
    *,
    period: str = "last_year",
    as_of: date | None = None,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """Contracts per bucket on each ledger, one column per ledger.

    On the EVM side both the address and the hash of a deployment may count,
    see :func:`~ledgerloom.operators.deployments.evm_contracts_or_transactions`.
    """
    span = series_span(period, as_of or today(), ledger.genesis)
    evm = (
        evm_contracts_or_transactions(ledger, span, topic=topic, signatures=signatures)
        .groupBy(F.col("bucket").alias("day"))
        .agg(F.countDistinct("contract").alias("evm"))
    )
    native_n, evm_n = F.col("native"), F.col("evm")
    full = native_n + evm_n
    return (
        align(_native_contracts(ledger, span), evm, "day")
        .select(
            "day",
            native_n.alias("new_cadence_contracts"),
            running(native_n, "day").alias("total_cadence_contracts"),
            evm_n.alias("new_evm_contracts"),
            running(evm_n, "day").alias("total_evm_contracts"),
            full.alias("full_contracts"),
            running(full, "day").alias("total_full_contracts"),
            trailing_mean(full, "day").alias("rolling_avg_new_contracts"),
        )
        .orderBy(F.col("day").desc())
    )


def deployers_over_time(
    ledger: Ledger,
    *,
    period: str = "last_year",
    as_of: date | None = None,
    event_type: str = C.CONTRACT_ADDED_EVENT,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """Distinct deployers per bucket; a deployer counts in each active bucket."""
    span = series_span(period, as_of or today(), ledger.genesis)
    # One row per transaction and bucket, so the join cannot multiply events.
    added = (
        within(ledger.native_event, span)
        .filter(F.col("event_type") == event_type)
        .select("tx_id", span.bucket().alias("day"))
        .distinct()
    )
    native = (
        ledger.partner("native_tx", span)
        .select("tx_id", F.get(F.col("authorizers"), F.lit(0)).alias("deployer"))
        .join(added, "tx_id")
        .groupBy("day")
        .agg(F.countDistinct("deployer").alias("native"))
    )
    evm = (
        evm_deployments(ledger, span, topic=topic, signatures=signatures)
        .groupBy(F.col("bucket").alias("day"))
        .agg(F.countDistinct("creator").alias("evm"))
    )
    native_n, evm_n = F.col("native"), F.col("evm")
    full = native_n + evm_n
    return (
        align(native, evm, "day")
        .select(
            "day",
            native_n.alias("new_cadence_deployerss"),
            running(native_n, "day").alias("total_cadence_deployers"),
            evm_n.alias("new_evm_deployerss"),
            running(evm_n, "day").alias("total_evm_deployers"),
            full.alias("full_deployers"),
            running(full, "day").alias("total_full_deployers"),
            trailing_mean(full, "day").alias("rolling_avg_full_deployers"),
        )
        .orderBy(F.col("day").desc())
    )


def weekly_native_contracts(
    ledger: Ledger, *, as_of: date | None = None, months: int = 12
) -> DataFrame:
    """Distinct native contracts with events per week of the last year."""
    span = Span(months_before(as_of or today(), months), None, "week")
    return (
        within(ledger.native_event, span)
        .groupBy(span.bucket().alias("date"))
        .agg(F.countDistinct("event_contract").alias("new_contracts"))
        .orderBy("date")
    )


def _weekly_evm_contracts(
    ledger: Ledger,
    as_of: date | None,
    months: int,
    who: Column,
    topic: str,
    signatures: Sequence[str],
) -> DataFrame:
    span = Span(months_before(as_of or today(), months), None, "week")
    return (
        evm_deployments(ledger, span, topic=topic, signatures=signatures)
        .filter(who)
        .groupBy(F.col("bucket").alias("date"))
        .agg(F.count("contract").alias("new_contracts"))
        .orderBy("date")
    )


def weekly_evm_contracts_coa(
    ledger: Ledger,
    *,
    as_of: date | None = None,
    months: int = 12,
    coa_prefix: str = C.COA_PREFIX,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """(contract, creator) pairs deployed per week by COA creators."""
    return _weekly_evm_contracts(
        ledger, as_of, months, _is_coa(coa_prefix), topic, signatures
    )


def weekly_evm_contracts_non_coa(
    ledger: Ledger,
    *,
    as_of: date | None = None,
    months: int = 12,
    coa_prefix: str = C.COA_PREFIX,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """(contract, creator) pairs deployed per week by other creators."""
    return _weekly_evm_contracts(
        ledger, as_of, months, ~_is_coa(coa_prefix), topic, signatures
    )


def contract_debuts_by_source(
    ledger: Ledger,
    *,
    debut_range: tuple[date, date] = C.DEBUT_RANGE,
    coa_prefix: str = C.COA_PREFIX,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """Contracts by the week of their debut over all history, per source.

    EVM debuts are per (contract, creator). The week's Monday has to lie in
    ``debut_range``, both ends included, and the running total starts there.
    Creators that are NULL fall to the non-COA source.
    """
    first, last = debut_range
    week = Span(grain="week")
    native = _native_debuts(ledger, Span()).select(
        week.bucket("debut").alias("date"),
        F.lit(C.NATIVE_LABEL).alias("source"),
        F.col("event_contract").alias("contract"),
    )
    if ledger.first_seen is not None:
        pairs = ledger.first_seen.seen(DEPLOYMENT_KIND).withColumn("date", week.bucket("first"))
    else:
        pairs = (
            evm_deployments(ledger, week, topic=topic, signatures=signatures)
            .groupBy("contract", "creator")
            .agg(F.min("bucket").alias("date"))
        )
    evm = (
        pairs.select(
            "date",
            F.when(_is_coa(coa_prefix), F.lit(C.COA_SOURCE_LABEL))
            .otherwise(F.lit(C.NON_COA_SOURCE_LABEL))
            .alias("source"),
            "contract",
        )
    )
    return (
        stack(native, evm)
        .filter(F.col("date").between(midnight(first), midnight(last)))
        .groupBy("date", "source")
        .agg(F.countDistinct("contract").alias("new_contracts"))
        .withColumn("unique_contracts", running(F.col("new_contracts"), "date", ["source"]))
        .orderBy("date", "source")
    )
