"""Every query against DuckDB, on the generated tables."""

import pytest

from checks.compare import connect, difference, duckdb_rows, spark_rows
from checks.registry import CHECKS, other_periods

REGISTERED = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return {sf_dir: connect(sf_dir) for sf_dir in (REGISTERED, SMALL)}


def _verify(spark, duck, check, sf_dir):
    expected = duckdb_rows(duck[sf_dir], check.sql())
    assert difference(spark_rows(check.run(spark, sf_dir)), expected) is None


@pytest.mark.parametrize("name", CHECKS)
def test_registered(spark, duck, name):
    _verify(spark, duck, CHECKS[name], REGISTERED)


@pytest.mark.parametrize("name,check", other_periods().items())
def test_other_periods(spark, duck, name, check):
    _verify(spark, duck, check, SMALL)


@pytest.mark.parametrize(
    "name", ["native_contracts_over_tx_threshold", "native_deployers_kpi", "fees_over_time"]
)
def test_shared_block_time_reads_less_but_counts_the_same(spark, name):
    """In the click tables events carry the time of their transaction."""
    from checks.registry import Check

    check = Check(
        name,
        "clicks",
        None if "threshold" in name else "last_month",
        {"threshold": 3} if "threshold" in name else {},
    )
    plain = spark_rows(check.run(spark, SMALL))
    assert plain[1]
    assert difference(spark_rows(check.run(spark, SMALL, shared_block_time=True)), plain) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHECKS) <= set(entry.oracle_sql())
