"""Token supply, staking and market metrics.

All inputs meet as daily series, so joins and windows here work on one row per
day; only the staking and TVL tables are large, and they are aggregated first.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions.measures import non_zero, running
from ledgerloom.functions.periods import midnight, today
from ledgerloom.sources.ledger import Ledger
from ledgerloom.sources.market import SERIES, market_points


def _locked_value(
    ledger: Ledger, chain_pattern: str, staking: str, liquid: str, locked: Sequence[str]
) -> DataFrame:
    """Locked value per day, split into staked, liquid and otherwise locked."""
    category, value = F.col("category"), F.col("chain_tvl")

    def part(condition: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))

    return (
        ledger.protocol_tvl.filter(F.col("chain").ilike(chain_pattern))
        .groupBy("date")
        .agg(
            part(category == staking).alias("tvl_staked"),
            part(category == liquid).alias("liquid_supply"),
            part(category.isin(*locked)).alias("non_staked_locked"),
        )
    )


def _staked_volume(
    ledger: Ledger, baseline: float, stake: Sequence[str], unstake: Sequence[str]
) -> DataFrame:
    """Running net stake per day on top of ``baseline``.

    Only days with a stake action exist; withdrawals of other days are lost.
    """
    action, amount = F.col("action"), F.col("amount")
    staking, unstaking = action.isin(*stake), action.isin(*unstake)
    daily = (
        ledger.staking_action.filter(staking | unstaking)
        .groupBy(F.to_date("block_timestamp").alias("date"))
        .agg(
            F.sum(F.when(staking, amount)).alias("staked"),
            F.sum(F.when(unstaking, amount)).alias("unstaked"),
            F.count(F.when(staking, F.lit(1))).alias("stake_actions"),
        )
        .filter(F.col("stake_actions") > 0)
    )
    zero = F.lit(0.0)
    net = F.coalesce("staked", zero) - F.coalesce("unstaked", zero)
    return daily.select("date", (running(net, "date") + F.lit(baseline)).alias("staked_volume"))


def _locked_and_staked(locked: DataFrame, staked: DataFrame) -> DataFrame:
    """Daily locked amounts, keyed by the midnight of the day."""
    return (
        locked.join(staked, "date")
        .select(
            F.col("date").cast("timestamp").alias("date"),
            (F.col("tvl_staked") + F.col("staked_volume")).alias("staked_locked"),
            "non_staked_locked",
            "liquid_supply",
        )
    )


def supply_breakdown_over_time(
    ledger: Ledger,
    *,
    as_of: date | None = None,
    days: int = 360,
    token: str = C.TOKEN,
    chain_pattern: str = C.CHAIN_PATTERN,
    locked_baseline: float = C.LOCKED_BASELINE,
    staking_category: str = C.STAKING_CATEGORY,
    liquid_category: str = C.LIQUID_CATEGORY,
    locked_categories: Sequence[str] = C.LOCKED_CATEGORIES,
    stake_actions: Sequence[str] = C.STAKE_ACTIONS,
    unstake_actions: Sequence[str] = C.UNSTAKE_ACTIONS,
) -> DataFrame:
    """Daily token supply by where it is held.

    Total supply is market cap over price; a price of 0 fails under ANSI mode.
    If a moment is quoted twice, the largest quotient counts. Only quotes
    stamped at midnight meet the daily locked amounts.
    """
    as_of = as_of or today()
    series, value = F.col("series"), F.col("value")
    supply = (
        market_points(ledger.market_chart, days=days, as_of=as_of)
        .filter(F.col("date") < midnight(as_of))
        .groupBy("date")
        .agg(
            F.countDistinct("series").alias("found"),
            F.max(F.when(series == "market_caps", value)).alias("market_cap"),
            F.min(F.when(series == "prices", value)).alias("price"),
        )
        .filter(F.col("found") == len(SERIES))
        .select("date", (F.col("market_cap") / F.col("price")).alias("total_supply"))
    )
    total = F.col("total_supply")
    unstaked = total - (F.col("staked_locked") + F.col("liquid_supply") + F.col("non_staked_locked"))
    held = _locked_and_staked(
        _locked_value(ledger, chain_pattern, staking_category, liquid_category, locked_categories),
        _staked_volume(ledger, locked_baseline, stake_actions, unstake_actions),
    )
    return (
        supply.join(held, "date")
        .select(
            "date",
            F.lit(token).alias("token"),
            total.alias("total_supply_actual"),
            "staked_locked",
            "non_staked_locked",
            unstaked.alias("unstaked_circulating"),
            "liquid_supply",
            (total - unstaked).alias("free_circulating_supply"),
        )
        .orderBy(F.col("date").desc())
    )


def staked_locked_kpi(
    ledger: Ledger,
    *,
    as_of: date | None = None,
    days: int = 180,
    chain_pattern: str = C.CHAIN_PATTERN,
    locked_baseline: float = C.LOCKED_BASELINE,
    staking_category: str = C.STAKING_CATEGORY,
    liquid_category: str = C.LIQUID_CATEGORY,
    locked_categories: Sequence[str] = C.LOCKED_CATEGORIES,
    stake_actions: Sequence[str] = C.STAKE_ACTIONS,
    unstake_actions: Sequence[str] = C.UNSTAKE_ACTIONS,
) -> DataFrame:
    """Staked and locked amount of the day before ``as_of``.

    The day needs a market cap, and the snapshot needs prices and volumes.
    """
    as_of = as_of or today()
    day = midnight(as_of - timedelta(days=1))
    series = F.col("series")
    quoted = (
        market_points(ledger.market_chart, days=days, as_of=as_of)
        .filter((series != "market_caps") | (F.col("date") == day))
        .agg(
            F.countDistinct("series").alias("found"),
            F.max(F.when(series == "market_caps", F.col("date"))).alias("date"),
        )
        .filter(F.col("found") == len(SERIES))
    )
    locked = _locked_and_staked(
        _locked_value(ledger, chain_pattern, staking_category, liquid_category, locked_categories),
        _staked_volume(ledger, locked_baseline, stake_actions, unstake_actions),
    )
    return (
        locked.filter(F.col("date") == day)
        .join(quoted, "date", "left_semi")
        .select("staked_locked")
    )


def market_snapshot_kpi(
    ledger: Ledger, *, as_of: date | None = None, days: int = 30, token: str = C.TOKEN
) -> DataFrame:
    """Latest market cap, price and volume, and the largest "supply".

    Quotes of the three series are not matched by date: price and volume are
    means over their whole series, and supply here is market cap times price.
    Price needs a market cap since the day before ``as_of``; volume averages in
    a 0 for every older market-cap date. One aggregate over all points gives
    the same numbers as combining every point with every other.
    """
    as_of = as_of or today()
    per_point = (
        market_points(ledger.market_chart, days=days, as_of=as_of)
        .groupBy("series", "date")
        .agg(
            F.avg("value").alias("mean"),
            F.sum("value").alias("sum"),
            F.count("value").alias("values"),
        )
    )
    series, moment = F.col("series"), F.col("date")
    is_cap = (series == "market_caps") & (moment < midnight(as_of))
    is_recent = is_cap & (moment >= midnight(as_of - timedelta(days=1)))

    def mean_of(name: str) -> Column:
        values = F.sum(F.when(series == name, F.col("values")))
        return F.sum(F.when(series == name, F.col("sum"))) / non_zero(values)

    totals = per_point.agg(
        F.count(F.when(is_cap, 1)).alias("caps"),
        F.count(F.when(is_recent, 1)).alias("recent"),
        F.count(F.when(series == "prices", 1)).alias("prices"),
        F.count(F.when(series == "total_volumes", 1)).alias("volumes"),
        F.max(
            F.when(is_recent, F.col("mean")).otherwise(F.when(is_cap, F.lit(0.0)))
        ).alias("market_cap"),
        F.max(F.when(is_cap, F.col("mean"))).alias("highest_cap"),
        F.min(F.when(is_cap, F.col("mean"))).alias("lowest_cap"),
        mean_of("prices").alias("price"),
        mean_of("total_volumes").alias("volume"),
    )
    price, recent, caps = F.col("price"), F.col("recent"), F.col("caps")
    older_only = F.when(caps > recent, F.lit(0.0))
    return totals.filter(
        (caps > 0) & (F.col("prices") > 0) & (F.col("volumes") > 0)
    ).select(
        F.lit(token).alias("token"),
        "market_cap",
        F.when(recent > 0, price).alias("price"),
        F.when(F.col("volume").isNotNull(), F.col("volume") * recent / caps)
        .otherwise(older_only)
        .alias("volume"),
        (F.when(price >= 0, F.col("highest_cap")).otherwise(F.col("lowest_cap")) * price).alias(
            "total_supply"
        ),
    )
