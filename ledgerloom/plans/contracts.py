"""Contract leaderboards and weekly contract trends."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions.measures import (
    is_contract_call,
    is_user_event,
    label_of,
    pct_change,
    per_user,
    previous,
    trailing_mean,
)
from ledgerloom.functions.periods import Span, ceil_date, report_start, today, within
from ledgerloom.operators.ranking import top_rows
from ledgerloom.operators.sequences import trailing_by_position, with_positions
from ledgerloom.sources.ledger import Ledger

_USERS, _INTERACTIONS = "unique_users", "total_interactions"


def _usage(df: DataFrame, keys: list[Column], user: str, min_users: int) -> DataFrame:
    """Distinct users and rows per key, for keys with enough users.

    Enough interactions follow from enough users. Saying so makes every reader
    of the aggregate need both measures, so that branches which read it several
    times share one scan and one shuffle.
    """
    return (
        df.groupBy(*keys)
        .agg(F.countDistinct(user).alias(_USERS), F.count(F.lit(1)).alias(_INTERACTIONS))
        .filter((F.col(_USERS) >= min_users) & (F.col(_INTERACTIONS) >= min_users))
    )


def _named(usage: DataFrame, ledger: Ledger, labels: Mapping[str, str]) -> DataFrame:
    """Put display names on usage per address.

    The facts are aggregated before they meet the contract dimension. An
    address listed several times repeats its interactions, as a row-level join
    would, and an address with several names gives one row per name.
    """
    names = ledger.evm_contract.groupBy("address", "name").agg(F.count(F.lit(1)).alias("listed"))
    address = F.col("contract_address")
    return (
        usage.join(names, address == F.col("address"), "left")
        .withColumn(_INTERACTIONS, F.col(_INTERACTIONS) * F.coalesce(F.col("listed"), F.lit(1)))
        .withColumn("contract_name", label_of(F.col("name"), address, labels))
        .drop("address", "name", "listed")
    )


def _native_usage(events: DataFrame, min_users: int, *keys: Column) -> DataFrame:
    contract = F.col("event_contract").alias("contract_name")
    return _usage(events, [contract, *keys], "event_from", min_users)


def _evm_usage(
    calls: DataFrame, ledger: Ledger, min_users: int, labels: Mapping[str, str], *keys: Column
) -> DataFrame:
    contract = F.col("to_address").alias("contract_address")
    return _named(_usage(calls, [contract, *keys], "from_address", min_users), ledger, labels)


def _leaderboard(usage: DataFrame, rank_by: str, k: int, tie_break: list[str]) -> DataFrame:
    columns = [
        F.col("contract_name"),
        F.col(_USERS),
        F.col(_INTERACTIONS),
        per_user(F.col(_INTERACTIONS), F.col(_USERS)).cast("double").alias(
            "avg_interactions_per_user"
        ),
    ]
    return top_rows(usage, rank_by, k, tie_break).select(*columns)


def _native_leaderboard(
    ledger: Ledger, rank_by: str, period: str, as_of: date | None, min_users: int, k: int
) -> DataFrame:
    span = Span(report_start(period, as_of or today()))
    events = within(ledger.native_event, span).filter(is_user_event())
    return _leaderboard(_native_usage(events, min_users), rank_by, k, ["contract_name"])


def _evm_leaderboard(
    ledger: Ledger,
    rank_by: str,
    period: str,
    as_of: date | None,
    min_users: int,
    k: int,
    labels: Mapping[str, str],
    compat_periods: bool,
) -> DataFrame:
    start = report_start(period, as_of or today())
    if start is not None and compat_periods:
        start = report_start("last_3_months", as_of or today())
    calls = within(ledger.evm_tx, Span(start)).filter(is_contract_call())
    return _leaderboard(
        _evm_usage(calls, ledger, min_users, labels),
        rank_by,
        k,
        ["contract_name", "contract_address"],
    )


def native_contract_leaderboard_by_users(
    ledger: Ledger,
    *,
    period: str = "last_month",
    as_of: date | None = None,
    min_users: int = C.MIN_USERS,
    k: int = C.TOP_K,
) -> DataFrame:
    """Native contracts with the most distinct senders in the period."""
    return _native_leaderboard(ledger, _USERS, period, as_of, min_users, k)


def native_contract_leaderboard_by_interactions(
    ledger: Ledger,
    *,
    period: str = "last_month",
    as_of: date | None = None,
    min_users: int = C.MIN_USERS,
    k: int = C.TOP_K,
) -> DataFrame:
    """Native contracts with the most events in the period."""
    return _native_leaderboard(ledger, _INTERACTIONS, period, as_of, min_users, k)


def evm_contract_leaderboard_by_users(
    ledger: Ledger,
    *,
    period: str = "last_month",
    as_of: date | None = None,
    min_users: int = C.MIN_USERS,
    k: int = C.TOP_K,
    labels: Mapping[str, str] = C.LABEL_PUNCHSWAP,
    compat_periods: bool = True,
) -> DataFrame:
    """EVM contracts with the most distinct senders.

    With ``compat_periods`` every bounded period means the last three months,
    which is how the dashboards have always computed this board.
    """
    return _evm_leaderboard(
        ledger, _USERS, period, as_of, min_users, k, labels, compat_periods
    )


def evm_contract_leaderboard_by_interactions(
    ledger: Ledger,
    *,
    period: str = "last_month",
    as_of: date | None = None,
    min_users: int = C.MIN_USERS,
    k: int = C.TOP_K,
    labels: Mapping[str, str] = C.LABELS_WELL_KNOWN,
    compat_periods: bool = True,
) -> DataFrame:
    """EVM contracts with the most calls; ``compat_periods`` as for users."""
    return _evm_leaderboard(
        ledger, _INTERACTIONS, period, as_of, min_users, k, labels, compat_periods
    )


def _week() -> Column:
    return Span(grain="week").bucket().alias("week_start")


def _top_names(weekly: DataFrame, rank_by: str, k: int) -> DataFrame:
    """The ``k`` names with the best single week, in column ``top_name``.

    Ties go to the better other measure, then to the name. An unnamed contract
    can take a rank but is not listed.
    """
    tie_break = _INTERACTIONS if rank_by == _USERS else _USERS
    best = weekly.groupBy("contract_name").agg(
        F.max(rank_by).alias("best"), F.max(tie_break).alias("second")
    )
    return (
        best.orderBy(
            F.col("best").desc(), F.col("second").desc(), F.col("contract_name").asc_nulls_last()
        )
        .limit(k)
        .select(F.col("contract_name").alias("top_name"))
        .filter(F.col("top_name").isNotNull())
    )


def _only(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    return df.join(names, F.col(column).eqNullSafe(F.col(names.columns[0])), "left_semi")


def _weeks_from(since: date) -> Span:
    """The whole weeks that start in a period."""
    return Span(ceil_date(since, "week"))


def _addresses_named(ledger: Ledger, labels: Mapping[str, str], names: DataFrame) -> DataFrame:
    """Addresses that may be shown under one of ``names``.

    Listed ones and those with a fixed label by that; an address without
    either is shown as itself.
    """
    address = F.col("address")
    shown = ledger.evm_contract.select(
        address, label_of(F.col("name"), address, labels).alias("shown")
    )
    if labels:
        fixed = shown.sparkSession.createDataFrame(list(labels.items()), shown.schema)
        shown = shown.union(fixed)
    behind = names.join(shown, F.col("top_name") == F.col("shown"), "left")
    either = F.explode(F.array("top_name", "address"))
    return behind.select(either.alias("known_address")).distinct()


def _means() -> dict[str, Column]:
    return {
        "rolling_4week_users": F.col(_USERS),
        "rolling_4week_interactions": F.col(_INTERACTIONS),
        "rolling_4week_avg_interactions": F.col("ratio"),
    }


def _trend_columns(df: DataFrame) -> DataFrame:
    users, before = F.col(_USERS), F.col("prev_week_users")
    return df.orderBy(
        F.col("week_start").desc(),
        F.col(_USERS).desc(),
        F.col("contract_name").asc(),
    ).select(
        "contract_name",
        "week_start",
        users.alias("weekly_users"),
        before,
        pct_change(users, before).cast("double").alias("wow_users_change"),
        F.col(_INTERACTIONS).alias("weekly_interactions"),
        F.col("ratio").cast("double").alias("weekly_avg_interactions"),
        *(F.round(F.col(c), 2).cast("double").alias(c) for c in _means()),
    )


def _native_trends(
    ledger: Ledger, rank_by: str, period: str, as_of: date | None, min_users: int, k: int
) -> DataFrame:
    since = report_start(period, as_of or today())
    events = ledger.native_event.filter(is_user_event())
    if since is not None:
        # Rank inside the period; only the winners' history is aggregated.
        ranked = _native_usage(within(events, _weeks_from(since)), min_users, _week())
        top = _top_names(ranked, rank_by, k)
        events = _only(events, "event_contract", top)
    weekly = _native_usage(events, min_users, _week()).withColumn(
        "ratio", per_user(F.col(_INTERACTIONS), F.col(_USERS))
    )
    # For all of history, ranking and rows share one aggregate.
    rows = weekly if since is not None else _only(weekly, "contract_name", _top_names(weekly, rank_by, k))
    # There is one row per name and week, so the windows stay small.
    by_name = ["contract_name"]
    rows = rows.withColumn("prev_week_users", previous(F.col(_USERS), "week_start", by_name))
    for name, value in _means().items():
        rows = rows.withColumn(name, trailing_mean(value, "week_start", by_name))
    return _trend_columns(rows)


def _evm_trends(
    ledger: Ledger,
    rank_by: str,
    period: str,
    as_of: date | None,
    min_users: int,
    k: int,
    labels: Mapping[str, str],
) -> DataFrame:
    since = report_start(period, as_of or today())
    calls = ledger.evm_tx.filter(is_contract_call())
    top = None
    if since is not None:
        # As for native contracts; several addresses can stand behind a name.
        ranked = _evm_usage(
            within(calls, _weeks_from(since)), ledger, min_users, labels, _week()
        )
        top = _top_names(ranked, rank_by, k)
        calls = _only(calls, "to_address", _addresses_named(ledger, labels, top))
    weekly = _evm_usage(calls, ledger, min_users, labels, _week()).withColumn(
        "ratio", per_user(F.col(_INTERACTIONS), F.col(_USERS))
    )
    rows = _only(weekly, "contract_name", _top_names(weekly, rank_by, k) if top is None else top)
    # Many addresses can share a name, so neighbours are found by position.
    numbered = with_positions(rows, "contract_name", "week_start", "contract_address")
    trailing = trailing_by_position(
        numbered.drop("contract_address"),
        "contract_name",
        means=_means(),
        lags={"prev_week_users": F.col(_USERS)},
    )
    return _trend_columns(trailing)


def native_contract_trends_by_users(
    ledger: Ledger,
    *,
    period: str = "last_month",
    as_of: date | None = None,
    min_users: int = C.MIN_USERS,
    k: int = C.TOP_K,
) -> DataFrame:
    """Weekly usage of the native contracts with the best week by senders.

    The period picks the contracts; all their weeks are returned. Previous and
    trailing values go by rows, so a week below ``min_users`` leaves no gap.
    """
    return _native_trends(ledger, _USERS, period, as_of, min_users, k)


def native_contract_trends_by_interactions(
    ledger: Ledger,
    *,
    period: str = "last_month",
    as_of: date | None = None,
    min_users: int = C.MIN_USERS,
    k: int = C.TOP_K,
) -> DataFrame:
    """As :func:`native_contract_trends_by_users`, contracts picked by events."""
    return _native_trends(ledger, _INTERACTIONS, period, as_of, min_users, k)


def evm_contract_trends_by_users(
    ledger: Ledger,
    *,
    period: str = "last_month",
    as_of: date | None = None,
    min_users: int = C.MIN_USERS,
    k: int = C.TOP_K,
    labels: Mapping[str, str] = C.LABEL_PUNCHSWAP,
) -> DataFrame:
    """Weekly usage of the EVM contracts with the best week by senders.

    Usage is per address, previous and trailing values are per name; addresses
    of one name follow each other inside a week.
    """
    return _evm_trends(ledger, _USERS, period, as_of, min_users, k, labels)


def evm_contract_trends_by_interactions(
    ledger: Ledger,
    *,
    period: str = "last_month",
    as_of: date | None = None,
    min_users: int = C.MIN_USERS,
    k: int = C.TOP_K,
    labels: Mapping[str, str] = C.LABELS_WELL_KNOWN,
) -> DataFrame:
    """As :func:`evm_contract_trends_by_users`, contracts picked by calls."""
    return _evm_trends(ledger, _INTERACTIONS, period, as_of, min_users, k, labels)
