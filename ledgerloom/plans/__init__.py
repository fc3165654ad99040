"""The metrics: functions from a :class:`~ledgerloom.sources.Ledger` to a DataFrame."""

from ledgerloom.plans.activity import (
    active_users_by_ledger,
    new_accounts_over_time,
    transactions_over_time,
)
from ledgerloom.plans.contracts import (
    evm_contract_leaderboard_by_interactions,
    evm_contract_leaderboard_by_users,
    evm_contract_trends_by_interactions,
    evm_contract_trends_by_users,
    native_contract_leaderboard_by_interactions,
    native_contract_leaderboard_by_users,
    native_contract_trends_by_interactions,
    native_contract_trends_by_users,
)
from ledgerloom.plans.deployments import (
    active_contracts_by_ledger,
    contract_counts_over_time,
    contract_debuts_by_source,
    contract_deployments_split,
    deployers_over_time,
    weekly_evm_contracts_coa,
    weekly_evm_contracts_non_coa,
    weekly_native_contracts,
)
from ledgerloom.plans.fees import fees_over_time, total_fees_kpi
from ledgerloom.plans.growth import (
    invocation_growth_weekly,
    transaction_growth_weekly,
    user_growth_weekly,
)
from ledgerloom.plans.kpis import (
    active_addresses_kpi,
    contract_deployments_kpi,
    evm_transactions_kpi,
    first_ever_accounts_kpi,
    native_deployers_by_actor_kpi,
    native_deployers_kpi,
    new_accounts_kpi,
    transactions_by_ledger_kpi,
)
from ledgerloom.plans.supply import (
    market_snapshot_kpi,
    staked_locked_kpi,
    supply_breakdown_over_time,
)
from ledgerloom.plans.thresholds import (
    evm_contracts_over_account_threshold,
    evm_contracts_over_tx_threshold,
    native_contracts_over_account_threshold,
    native_contracts_over_tx_threshold,
)

METRICS = {
    f.__name__: f
    for f in (
        fees_over_time,
        transactions_over_time,
        supply_breakdown_over_time,
        new_accounts_over_time,
        contract_deployments_split,
        evm_contract_trends_by_interactions,
        total_fees_kpi,
        evm_contract_leaderboard_by_users,
        native_contract_leaderboard_by_interactions,
        active_contracts_by_ledger,
        active_users_by_ledger,
        evm_contract_leaderboard_by_interactions,
        user_growth_weekly,
        contract_deployments_kpi,
        native_contract_trends_by_interactions,
        contract_counts_over_time,
        staked_locked_kpi,
        evm_contract_trends_by_users,
        invocation_growth_weekly,
        new_accounts_kpi,
        native_contract_leaderboard_by_users,
        deployers_over_time,
        evm_transactions_kpi,
        native_deployers_kpi,
        transactions_by_ledger_kpi,
        active_addresses_kpi,
        market_snapshot_kpi,
        transaction_growth_weekly,
        native_contract_trends_by_users,
        weekly_evm_contracts_non_coa,
        weekly_evm_contracts_coa,
        native_contracts_over_account_threshold,
        weekly_native_contracts,
        native_contracts_over_tx_threshold,
        evm_contracts_over_account_threshold,
        contract_debuts_by_source,
        evm_contracts_over_tx_threshold,
        first_ever_accounts_kpi,
        native_deployers_by_actor_kpi,
    )
}
