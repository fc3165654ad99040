"""Transaction, user and new-account series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions.measures import pct_change, previous, running, trailing_mean
from ledgerloom.functions.periods import ceil_date, floor_date, midnight, series_span, today, within
from ledgerloom.operators.accounts import all_accounts, evm_accounts, native_accounts
from ledgerloom.operators.combining import stack
from ledgerloom.operators.ranking import first_seen
from ledgerloom.sources.ledger import Ledger
from ledgerloom.sources.state import ACCOUNT_KINDS, count_keys, whole_days


def transactions_over_time(
    ledger: Ledger, *, period: str = "last_year", as_of: date | None = None
) -> DataFrame:
    """Distinct transactions per bucket on both ledgers together.

    Adds the previous bucket, the difference as text, the change in percent
    (0 in the first bucket), a running total and a mean over four buckets.
    """
    span = series_span(period, as_of or today(), ledger.genesis)
    per_ledger = stack(
        *(
            within(df, span)
            .groupBy(span.bucket().alias("time_stamp"))
            .agg(F.countDistinct(key).alias("n"))
            for df, key in ((ledger.native_tx, "tx_id"), (ledger.evm_tx, "tx_hash"))
        )
    )
    n, before = F.col("n"), F.col("prev_period_transactions")
    return (
        per_ledger.groupBy("time_stamp")
        .agg(F.sum("n").alias("n"))
        .withColumn("prev_period_transactions", previous(n, "time_stamp"))
        .select(
            "time_stamp",
            n.alias("transactions"),
            before,
            F.concat(
                n.cast("string"),
                F.lit(" ("),
                F.coalesce(n - before, F.lit(0)).cast("string"),
                F.lit(")"),
            ).alias("transactions_diff"),
            F.coalesce(pct_change(n, before).cast("double"), F.lit(0.0)).alias("pcg_diff"),
            running(n, "time_stamp").alias("total_transactions"),
            trailing_mean(n, "time_stamp").alias("rolling_avg"),
        )
        .orderBy(F.col("time_stamp").desc())
    )


def new_accounts_over_time(
    ledger: Ledger, *, period: str = "last_year", as_of: date | None = None
) -> DataFrame:
    """Accounts by the bucket in which the period first shows them.

    An account active on both ledgers counts once. A bucket that only unnamed
    actors opened is kept with a count of 0.
    """
    span = series_span(period, as_of or today(), ledger.genesis)
    accounts = all_accounts(ledger, span, span.bucket().alias("bucket"))
    daily = (
        first_seen(accounts, "account", F.col("bucket"), "day")
        .groupBy("day")
        .agg(F.count("account").alias("daily_new_accounts"))
    )
    count = F.col("daily_new_accounts")
    return daily.select(
        "day",
        count,
        running(count, "day").alias("total_new_accounts"),
        trailing_mean(count, "day").alias("rolling_avg_new_accounts"),
    ).orderBy(F.col("day").desc())


def active_users_by_ledger(
    ledger: Ledger,
    *,
    period: str = "last_year",
    as_of: date | None = None,
    compat_week_cut: bool = True,
) -> DataFrame:
    """Distinct users per bucket for each ledger and for their sum.

    The sum counts a user of both ledgers twice. Ledger rows leave out the open
    bucket, sum rows do not; with ``compat_week_cut`` every row has to start
    before the current week. Only sum rows carry the four-bucket mean.
    """
    as_of = as_of or today()
    span = series_span(period, as_of, ledger.genesis)
    cut = floor_date(as_of, "week") if compat_week_cut else None
    read = span.until(ceil_date(cut, span.grain) if cut else None)
    bucket = span.bucket().alias("day")
    sides = (
        (native_accounts, ACCOUNT_KINDS["native"], C.NATIVE_LABEL),
        (evm_accounts, ACCOUNT_KINDS["evm"], C.EVM_LABEL),
    )

    def count(accounts, kind: str) -> DataFrame:
        if ledger.day_keys is not None and span.grain != "hour":
            days = whole_days(ledger.day_keys.days(kind, "account"), read)
            return count_keys(days, F.date_trunc(span.grain, "block_date"), "day", "users")
        return accounts(ledger, read, bucket).groupBy("day").agg(F.countDistinct("account").alias("users"))

    users = stack(
        *(count(accounts, kind).withColumn("ledger", F.lit(label)) for accounts, kind, label in sides)
    )
    closed = F.when(F.col("day") < midnight(span.end), F.col("ledger"))
    rows = (
        users.select(
            "day", "users", F.explode(F.array(closed, F.lit(C.COMBINED_LABEL))).alias("type")
        )
        .filter(F.col("type").isNotNull())
        .groupBy("day", "type")
        .agg(F.sum("users").alias("active_users"))
    )
    mean = trailing_mean(F.col("active_users"), "day", ["type"])
    result = rows.select(
        "day",
        "type",
        "active_users",
        F.when(F.col("type") == C.COMBINED_LABEL, mean).alias("rolling_avg"),
    )
    if cut:
        result = result.filter(F.col("day") < midnight(cut))
    return result.orderBy(F.col("day").desc(), "type")
