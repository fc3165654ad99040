"""Week-over-week growth of both ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.measures import (
    is_contract_call,
    is_user_event,
    pct_change,
    previous,
    trailing_mean,
)
from ledgerloom.functions.periods import Span, ceil_date, midnight, report_start, today, within
from ledgerloom.operators.accounts import evm_accounts, native_accounts
from ledgerloom.operators.combining import align, stack
from ledgerloom.sources.ledger import Ledger
from ledgerloom.sources.state import ACCOUNT_KINDS, DayKeys, DayManifest, count_keys

# The rows that growth counts, by kind: table and condition.
COUNTED = {
    "native_user_event": ("native_event", is_user_event),
    "native_invocation": ("native_event", lambda: F.col("tx_succeeded")),
    "evm_contract_call": ("evm_tx", is_contract_call),
}


def counted(ledger: Ledger, kind: str) -> DataFrame:
    table, condition = COUNTED[kind]
    return ledger[table].filter(condition())


def add_day_counts(manifest: DayManifest, ledger: Ledger, span: Span = Span()) -> None:
    """Add the days of ``span`` (default: all) of ``ledger`` to ``manifest``."""
    for kind in COUNTED:
        manifest.add(kind, within(counted(ledger, kind), span))


# The columns whose distinct values are counted, by kind.
COUNTED_KEYS = {
    "native_user_event": ("event_from", "event_contract"),
    "native_invocation": ("event_contract",),
    "evm_contract_call": ("from_address", "to_address"),
}


def add_day_keys(day_keys: DayKeys, ledger: Ledger, span: Span = Span()) -> None:
    """Add the days of ``span`` (default: all) of ``ledger`` to ``day_keys``: what growth and
    ``active_users_by_ledger`` count."""
    for kind, columns in COUNTED_KEYS.items():
        for column in columns:
            day_keys.add(kind, column, within(counted(ledger, kind), span))
    time = F.col("block_timestamp")
    day_keys.add(ACCOUNT_KINDS["native"], "account", native_accounts(ledger, span, time))
    day_keys.add(ACCOUNT_KINDS["evm"], "account", evm_accounts(ledger, span, time))


# Instead of a column to count distinct values of: count rows.
ROWS = "*"


def _weeks_of_facts(ledger: Ledger, kind: str, measures: Mapping[str, str], since: Column | None) -> DataFrame:
    rows = counted(ledger, kind)
    if since is not None:
        rows = rows.filter(F.col("block_timestamp") >= since)
        if "block_date" in rows.columns:
            rows = rows.filter(F.col("block_date") >= since.cast("date"))
    return rows.groupBy(Span(grain="week").bucket().alias("week")).agg(
        *(
            (F.count(F.lit(1)) if column == ROWS else F.countDistinct(column)).alias(name)
            for name, column in measures.items()
        )
    )


def _weeks_of_days(ledger: Ledger, kind: str, measures: Mapping[str, str], since: Column | None) -> DataFrame:
    """The same from the row counts and bitmaps of days."""
    week = F.date_trunc("week", "block_date")

    def bounded(days: DataFrame) -> DataFrame:
        return days if since is None else days.filter(F.col("block_date") >= since.cast("date"))

    def alone(counts: DataFrame, names: Sequence[str]) -> DataFrame:
        return counts.select(
            "week", *(F.col("n").alias(m) if m in names else F.lit(0).alias(m) for m in measures)
        )

    rows = bounded(ledger.manifest.days(kind)).groupBy(week.alias("week")).agg(F.sum("n").alias("n"))
    parts = [alone(rows, [name for name, column in measures.items() if column == ROWS])]
    for name, column in measures.items():
        if column != ROWS:
            days = bounded(ledger.day_keys.days(kind, column))
            parts.append(alone(count_keys(days, week, "week", "n"), [name]))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("week").agg(*(F.sum(name).alias(name) for name in measures))


def _last_week_before(monday: date, ledger: Ledger, kinds: Sequence[str]) -> Column:
    """The last week before ``monday`` that any of ``kinds`` has rows in; without one, ``monday``.

    That week may be arbitrarily old. The ledger's manifest has it; without one,
    a maximum without a shuffle finds it. As a scalar subquery it bounds the
    scans of the distinct counts.
    """
    if ledger.manifest is not None:
        days = ledger.manifest.latest(kinds, monday)
    else:
        days = stack(
            *(
                within(counted(ledger, kind), Span(None, monday)).agg(
                    F.max("block_timestamp").alias("latest")
                )
                for kind in kinds
            )
        )
    latest = days.agg(F.coalesce(F.date_trunc("week", F.max("latest")), midnight(monday)).alias("week"))
    return latest.scalar()


def _growth(
    ledger: Ledger,
    native_kind: str,
    native_measures: Mapping[str, str],
    evm_measures: Mapping[str, str],
    *,
    period: str,
    as_of: date | None,
    sums: dict[str, tuple[str, str]],
    growth_of: str,
    means: dict[str, str],
    order: Sequence[str],
) -> DataFrame:
    """Align the ledgers by week and add totals, growth and trailing means.

    Growth compares with the week before even when that week lies before the
    period; the means only see weeks of the period.
    """
    since = report_start(period, as_of or today())
    kinds = (native_kind, "evm_contract_call")
    first = None if since is None else _last_week_before(ceil_date(since, "week"), ledger, kinds)
    kept = ledger.manifest is not None and ledger.day_keys is not None
    weekly = _weeks_of_days if kept else _weeks_of_facts
    native, evm = (
        weekly(ledger, kind, measures, first)
        for kind, measures in zip(kinds, (native_measures, evm_measures), strict=True)
    )
    weeks = align(native, evm, "week")
    for name, (left, right) in sums.items():
        weeks = weeks.withColumn(name, F.col(left) + F.col(right))
    total = F.col(growth_of)
    weeks = weeks.withColumn("_before", previous(total, "week"))
    if since is not None:
        weeks = weeks.filter(F.col("week") >= midnight(since))
    weeks = weeks.withColumn(
        "wow_growth_pct", F.round(pct_change(total, F.col("_before")), 2).cast("double")
    )
    for name, source in means.items():
        weeks = weeks.withColumn(name, trailing_mean(F.col(source), "week"))
    return weeks.select(*order).orderBy(F.col("week").desc_nulls_first())


def user_growth_weekly(
    ledger: Ledger, *, period: str = "last_year", as_of: date | None = None
) -> DataFrame:
    """Weekly distinct users and contracts of each ledger, with user growth."""
    return _growth(
        ledger,
        "native_user_event",
        {
            "cadence_users": "event_from",
            "cadence_contracts": "event_contract",
        },
        {
            "evm_users": "from_address",
            "evm_contracts": "to_address",
        },
        period=period,
        as_of=as_of,
        sums={"total_active_users": ("cadence_users", "evm_users")},
        growth_of="total_active_users",
        means={
            "moving_avg_4_weeks_cadence": "cadence_users",
            "moving_avg_4_weeks_evm": "evm_users",
        },
        order=[
            "week",
            "cadence_users",
            "cadence_contracts",
            "evm_users",
            "evm_contracts",
            "total_active_users",
            "wow_growth_pct",
            "moving_avg_4_weeks_cadence",
            "moving_avg_4_weeks_evm",
        ],
    )


def invocation_growth_weekly(
    ledger: Ledger, *, period: str = "last_year", as_of: date | None = None
) -> DataFrame:
    """Weekly contract invocations of each ledger, with growth of their sum.

    All events of successful native transactions count, with or without a
    sender.
    """
    return _growth(
        ledger,
        "native_invocation",
        {
            "cadence_invocations": ROWS,
            "unique_cadence_contracts": "event_contract",
        },
        {
            "evm_invocations": ROWS,
            "unique_evm_contracts": "to_address",
        },
        period=period,
        as_of=as_of,
        sums={
            "total_invocations": ("cadence_invocations", "evm_invocations"),
            "total_unique_contracts": ("unique_cadence_contracts", "unique_evm_contracts"),
        },
        growth_of="total_invocations",
        means={"moving_avg_4_weeks": "total_invocations"},
        order=[
            "week",
            "cadence_invocations",
            "unique_cadence_contracts",
            "evm_invocations",
            "unique_evm_contracts",
            "total_invocations",
            "total_unique_contracts",
            "wow_growth_pct",
            "moving_avg_4_weeks",
        ],
    )


def transaction_growth_weekly(
    ledger: Ledger, *, period: str = "last_year", as_of: date | None = None
) -> DataFrame:
    """Weekly user events and contract calls of each ledger, with growth."""
    return _growth(
        ledger,
        "native_user_event",
        {
            "cadence_transactions": ROWS,
            "cadence_contracts": "event_contract",
        },
        {
            "evm_transactions": ROWS,
            "evm_contracts": "to_address",
        },
        period=period,
        as_of=as_of,
        sums={"total_transactions": ("cadence_transactions", "evm_transactions")},
        growth_of="total_transactions",
        means={
            "moving_avg_4_weeks_cadence_txs": "cadence_transactions",
            "moving_avg_4_weeks_evm_txs": "evm_transactions",
        },
        order=[
            "week",
            "cadence_transactions",
            "cadence_contracts",
            "evm_transactions",
            "evm_contracts",
            "total_transactions",
            "wow_growth_pct",
            "moving_avg_4_weeks_cadence_txs",
            "moving_avg_4_weeks_evm_txs",
        ],
    )
