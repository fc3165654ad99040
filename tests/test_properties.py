"""Relations that have to hold between results, on the generated tables."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.views import spark_ledger
from ledger_rows import rows_of
from ledgerloom import METRICS
from ledgerloom.functions.measures import pct_change, per_user, running, trailing_mean
from ledgerloom.functions.periods import ceil_date, floor_date

CHAIN = "/root/testdata/sf0.001"
AS_OF = date(2001, 8, 1)


@pytest.fixture(scope="module")
def chain(spark):
    return spark_ledger(spark, CHAIN)


def _run(name, ledger, **options):
    return rows_of(METRICS[name](ledger, as_of=AS_OF, **options))


@pytest.mark.parametrize(
    "name,value,total",
    [
        ("transactions_over_time", "transactions", "total_transactions"),
        ("new_accounts_over_time", "daily_new_accounts", "total_new_accounts"),
        ("contract_deployments_split", "full_contracts", "total_full_contracts"),
        ("contract_counts_over_time", "new_evm_contracts", "total_evm_contracts"),
        ("deployers_over_time", "full_deployers", "total_full_deployers"),
    ],
)
def test_last_running_total_is_the_sum(chain, name, value, total):
    rows = _run(name, chain, period="last_year")
    assert rows[0][total] == sum(r[value] for r in rows)


def test_sum_of_ledgers(chain):
    by_day = {}
    for r in _run("active_users_by_ledger", chain, period="last_year"):
        by_day.setdefault(r["day"], {})[r["type"]] = r["active_users"]
    assert by_day
    for users in by_day.values():
        assert users["EVM + Cadence"] == users.get("EVM", 0) + users.get("Cadence", 0)


def test_deduplicated_accounts_are_not_more(chain):
    (new,) = _run("new_accounts_kpi", chain, period="all_time")
    (active,) = _run("active_addresses_kpi", chain, period="all_time")
    assert new["total_new_accounts_last_24h"] <= active["total_active_addresses"]
    series = _run("new_accounts_over_time", chain, period="all_time")
    assert series[0]["total_new_accounts"] == new["total_new_accounts_last_24h"]


def test_boards_respect_the_threshold_and_the_limit(chain):
    rows = _run("evm_contract_leaderboard_by_users", chain, period="all_time", min_users=7, k=4)
    assert 0 < len(rows) <= 4
    assert all(r["unique_users"] >= 7 for r in rows)


def test_constant_series(spark):
    rows = rows_of(
        spark.range(10).select(
            "id",
            trailing_mean(F.lit(3), "id").alias("mean"),
            running(F.lit(3), "id").alias("total"),
        )
    )
    assert {r["mean"] for r in rows} == {3.0}
    assert max(r["total"] for r in rows) == 30


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(0, 10**6)), min_size=1, max_size=50))
def test_ratios_are_rounded_half_up(spark, pairs):
    rows = rows_of(
        spark.createDataFrame(pairs, "a BIGINT, b BIGINT").select(
            "a",
            "b",
            per_user(F.col("a"), F.col("b")).alias("ratio"),
            pct_change(F.col("a"), F.col("b")).alias("pct"),
        )
    )
    for r in rows:
        a, b = r["a"], r["b"]
        if b == 0:
            assert r["ratio"] is None and r["pct"] is None
            continue
        assert int(r["ratio"] * 100) == (200 * a + b) // (2 * b)
        sign = 1 if a >= b else -1
        assert int(r["pct"] * 10_000) == sign * ((2_000_000 * abs(a - b) + b) // (2 * b))


@given(st.dates(date(1990, 1, 1), date(2100, 1, 1)), st.sampled_from(["month", "week", "day", "hour"]))
def test_bucket_bounds_enclose_the_day(day, grain):
    assert floor_date(day, grain) <= day <= ceil_date(day, grain)
    assert floor_date(ceil_date(day, grain), grain) == ceil_date(day, grain)
