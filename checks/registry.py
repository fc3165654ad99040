"""Every checked query: a metric, its arguments and its DuckDB counterpart."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle
from checks.views import WORLDS, spark_ledger
from ledgerloom import METRICS

SERIES = (
    "fees_over_time",
    "transactions_over_time",
    "new_accounts_over_time",
    "contract_deployments_split",
    "active_contracts_by_ledger",
    "active_users_by_ledger",
    "contract_counts_over_time",
    "deployers_over_time",
    "new_accounts_kpi",
)
KPIS = (
    "total_fees_kpi",
    "contract_deployments_kpi",
    "evm_transactions_kpi",
    "native_deployers_kpi",
    "transactions_by_ledger_kpi",
    "active_addresses_kpi",
    "first_ever_accounts_kpi",
)
REPORTS = (
    "user_growth_weekly",
    "invocation_growth_weekly",
    "transaction_growth_weekly",
    "native_contract_leaderboard_by_users",
    "native_contract_leaderboard_by_interactions",
    "evm_contract_leaderboard_by_users",
    "evm_contract_leaderboard_by_interactions",
    "native_contract_trends_by_users",
    "native_contract_trends_by_interactions",
    "evm_contract_trends_by_users",
    "evm_contract_trends_by_interactions",
)

# Digits for quotients that the oracle gets by combining all points with all.
ROUND = {
    "market_snapshot_kpi": {"market_cap": 6, "price": 6, "volume": 6, "total_supply": 0},
}


@dataclass(frozen=True)
class Check:
    metric: str
    world: str = "chain"
    period: str | None = None
    options: dict = field(default_factory=dict)
    ledger: dict = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str, **ledger_options) -> DataFrame:
        arguments = dict(self.options)
        if self.period is not None:
            arguments["period"] = self.period
        if self.metric not in ("contract_debuts_by_source", "native_deployers_by_actor_kpi"):
            arguments["as_of"] = WORLDS[self.world][1]
        ledger = spark_ledger(spark, sf_dir, self.world, **self.ledger, **ledger_options)
        df = METRICS[self.metric](ledger, **arguments)
        digits = ROUND.get(self.metric, {})
        return df.withColumns({c: F.round(c, n) for c, n in digits.items()})

    def sql(self) -> str:
        build = getattr(oracle, self.metric)
        options = dict(self.options)
        if "compat_week_cut" in options:
            options["week_cut"] = options.pop("compat_week_cut")
        return build(oracle.World(self.world), self.period, **options)


def _checks() -> dict[str, Check]:
    checks = {name: Check(name, period="all_time") for name in SERIES + KPIS + REPORTS}
    for name in (
        "native_deployers_by_actor_kpi",
        "supply_breakdown_over_time",
        "staked_locked_kpi",
        "market_snapshot_kpi",
        "weekly_native_contracts",
        "weekly_evm_contracts_coa",
        "weekly_evm_contracts_non_coa",
    ):
        checks[name] = Check(name)
    # Thresholds and dates fitted to the test tables.
    checks["contract_debuts_by_source"] = Check(
        "contract_debuts_by_source",
        options={"debut_range": (date(1995, 1, 2), date(1995, 6, 26))},
    )
    for name in (
        "native_contracts_over_account_threshold",
        "native_contracts_over_tx_threshold",
        "evm_contracts_over_account_threshold",
        "evm_contracts_over_tx_threshold",
    ):
        checks[name] = Check(name, options={"threshold": 3})
    for name in SERIES + KPIS + REPORTS:
        for period in ("last_year", "last_3_months", "last_month", "last_week"):
            checks[f"{name}__{period}"] = Check(name, period=period)
    for name in SERIES + KPIS:
        checks[f"{name}__last_24h"] = Check(name, "clicks", "last_24h")
    for name in ("evm_contract_leaderboard_by_users", "evm_contract_leaderboard_by_interactions"):
        checks[f"{name}__true_period"] = Check(
            name, period="last_year", options={"compat_periods": False}
        )
    for world, period in (("chain", "all_time"), ("clicks", "last_24h")):
        checks[f"active_users_by_ledger__{period}_uncut"] = Check(
            "active_users_by_ledger", world, period, {"compat_week_cut": False}
        )
    checks["active_users_by_ledger__last_24h_monday"] = Check(
        "active_users_by_ledger", "monday", "last_24h"
    )
    for name in REPORTS:
        if name.startswith("evm_"):
            checks[f"{name}__labelled"] = Check(name, "labelled", "last_year")
    for name in (
        "fees_over_time",
        "total_fees_kpi",
        "user_growth_weekly",
        "native_contract_leaderboard_by_users",
        "native_contract_trends_by_interactions",
    ):
        checks[f"{name}__raw_events"] = Check(name, "raw", "last_year")
    checks["market_snapshot_kpi__json"] = Check("market_snapshot_kpi", "json")
    # Events and logs with the time of their transaction: both sides of a join are bounded.
    shared = {"shared_block_time": True}
    for name in ("fees_over_time", "total_fees_kpi", "deployers_over_time", "native_deployers_kpi"):
        checks[f"{name}__shared_time"] = Check(name, "clicks", "last_week", ledger=shared)
    checks["native_contracts_over_tx_threshold__shared_time"] = Check(
        "native_contracts_over_tx_threshold", "clicks", options={"threshold": 3}, ledger=shared
    )
    # From the first-seen state and the manifest, which are built from the same tables.
    state = {"state": True}
    for name in (
        "first_ever_accounts_kpi",
        "contract_deployments_split",
        "user_growth_weekly",
        "invocation_growth_weekly",
        "transaction_growth_weekly",
    ):
        checks[f"{name}__state"] = Check(name, "clicks", "last_week", ledger=state)
    checks["first_ever_accounts_kpi__state_last_24h"] = Check(
        "first_ever_accounts_kpi", "clicks", "last_24h", ledger=state
    )
    checks["contract_debuts_by_source__state"] = Check(
        "contract_debuts_by_source",
        "clicks",
        options={"debut_range": (date(2024, 1, 1), date(2024, 1, 31))},
        ledger=state,
    )
    # Distinct counts as unions of the bitmaps of days.
    for name, period in (
        ("user_growth_weekly", "all_time"),
        ("invocation_growth_weekly", "last_week"),
        ("transaction_growth_weekly", "last_month"),
        ("active_users_by_ledger", "last_month"),
    ):
        checks[f"{name}__day_keys"] = Check(name, "clicks", period, ledger={"day_keys": True})
    return checks


CHECKS = _checks()


def other_periods() -> dict[str, Check]:
    """Weeks of the click world, which the tests run besides :data:`CHECKS`."""
    more = {}
    for name in SERIES + KPIS + REPORTS:
        more[f"{name}__clicks_last_week"] = Check(name, "clicks", "last_week")
    return more
