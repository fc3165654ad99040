"""Fixed values.

Everything in this module is data that results depend on: event names,
addresses, labels and thresholds of the two ledgers. Event names, addresses,
signatures, categories, actions, name labels and thresholds are defaults of the
metrics' arguments; the ledger and source labels in results are fixed.
"""

from __future__ import annotations

from datetime import date

# First day of the "all time" period.
GENESIS = date(2020, 1, 1)

# Ledger labels in long-format results.
NATIVE_LABEL = "Cadence"
EVM_LABEL = "EVM"
COMBINED_LABEL = "EVM + Cadence"
COA_SOURCE_LABEL = "COA EVM Contract"
NON_COA_SOURCE_LABEL = "Non-COA EVM Contract"

# Native events the metrics look for.
FEE_CONTRACT = "A.f919ee77447b7497.FlowFees"
FEE_EVENT = "FeesDeducted"
CONTRACT_ADDED_EVENT = "AccountContractAdded"

# How an EVM deployment is recognised.
OWNERSHIP_TOPIC = "0x8be0079c531659141344cd1fd0a4f28419497f9722a3daafe3b4186f6b6457e0"
CONSTRUCTOR_SIGNATURES = ("0x60c06040", "0x60806040")
COA_PREFIX = "0x0000000000000000000000020000000000000000"
EMPTY_CALL_DATA = "0x"

# Names of EVM contracts that the contract dimension lacks.
LABEL_PUNCHSWAP = {
    "0xf45afe28fd5519d5f8c1d4787a4d5f724c0efa4d": "Punchswap",
}
LABELS_WELL_KNOWN = {
    "0xf45afe28fd5519d5f8c1d4787a4d5f724c0efa4d": "Punchswap",
    "0x3219b81ef5af1dceb742c9befd2df618a3376fab": "SubstanceProxy",
    "0x3ef68d3f7664b2805d4e88381b64868a56f88bc4": "Trado",
}

# Infrastructure contracts left out of the threshold reports.
INFRASTRUCTURE_CONTRACTS = (
    "A.f233dcee88fe0abe.FungibleToken",
    "A.f919ee77447b7497.FlowFees",
    "A.1654653399040a61.FlowToken",
    "A.1d7e57aa55817448.NonFungibleToken",
    "A.1d7e57aa55817448.NonFungibleToken.NFT.ResourceDestr",
    "A.e467b9dd11fa00df.EVM",
    "A.4eb8a10cb9f87357.NFTStorefrontV2",
    "A.b8ea91944fd51c43.OffersV2",
    "A.4eb8a10cb9f87357.NFTStorefront",
    "A.ead892083b3e2c6c.DapperUtilityCoin",
    "flow",
)

# Token, chain and staking vocabulary of the supply metrics.
TOKEN = "FLOW"
CHAIN_PATTERN = "%Flow%"
STAKING_CATEGORY = "Staking Pool"
LIQUID_CATEGORY = "Liquid Staking"
LOCKED_CATEGORIES = ("Lending", "Services", "Derivatives", "Launchpad")
STAKE_ACTIONS = ("DelegatorTokensCommitted", "TokensCommitted")
UNSTAKE_ACTIONS = ("UnstakedTokensWithdrawn", "DelegatorUnstakedTokensWithdrawn")
LOCKED_BASELINE = 1.6e8

# Report thresholds.
MIN_USERS = 5
TOP_K = 10
ACCOUNT_THRESHOLD = 10_000
NATIVE_TX_THRESHOLD = 50_000
EVM_TX_THRESHOLD = 10_000
THRESHOLD_WEEKS = 12
DEBUT_RANGE = (date(2025, 5, 30), date(2025, 6, 6))
