"""What the physical plans look like."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, spark_rows
from checks.registry import CHECKS
from checks.views import spark_ledger
from ledgerloom import METRICS, Ledger
from ledgerloom.sources import write_by_day

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
BASE = [name for name in CHECKS if "__" not in name]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(df):
    """Operators of the plan with their depth in the tree."""
    found = []
    for line in _plan(df).splitlines():
        match = re.match(r"^([ :+\-|*()\d]*?)(?:\*\(\d+\) )?([A-Z]\w+.*)$", line)
        if match:
            found.append((len(match.group(1)), match.group(2)))
    return found


@pytest.mark.parametrize("name", BASE)
def test_no_cross_joins_and_no_python(spark, name):
    plan = _plan(CHECKS[name].run(spark, SMALL))
    for operator in ("CartesianProduct", "NestedLoop", "Python", "InPandas", "InArrow"):
        assert operator not in plan


@pytest.mark.parametrize("name", BASE)
def test_single_partitions_only_hold_aggregates(spark, name):
    nodes = _nodes(CHECKS[name].run(spark, SMALL))
    for i, (depth, text) in enumerate(nodes):
        if text.startswith("Exchange SinglePartition"):
            below = []
            for d, t in nodes[i + 1 :]:
                if d <= depth:
                    break
                below.append(t)
            first = next(t for t in below if re.match(r"Hash|Object|Sort(Aggregate|Merge)|Filescan", t))
            assert re.match(r"(Hash|ObjectHash|Sort)Aggregate|SortMergeJoin", first), first
            assert any("Aggregate" in t for t in below)


@pytest.mark.parametrize(
    "name", [n for n in BASE if n not in ("market_snapshot_kpi", "native_deployers_by_actor_kpi")]
)
def test_broadcasts_are_bounded(spark, name):
    """With size-based broadcasts off, nothing is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(CHECKS[name].run(spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in plan
    if "trends" in name:
        assert "TakeOrderedAndProject(limit=10" in plan


def _fact_scans(plan):
    """Columns and pushed filters of the scans that are not the contract dimension."""
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan)
    return [(columns, pushed) for columns, pushed in scans if not columns.startswith("p_partkey")]


# Scans without a lower bound, where a rule looks at all history: the partner of
# a join whose range is set on the other side, marker logs, what came before.
UNBOUNDED = {
    "fees_over_time": 2,
    "total_fees_kpi": 2,
    "contract_deployments_split": 3,
    "active_contracts_by_ledger": 3,
    "contract_deployments_kpi": 3,
    "contract_counts_over_time": 3,
    "deployers_over_time": 4,
    "native_deployers_kpi": 1,
    "first_ever_accounts_kpi": 2,
    "user_growth_weekly": 8,
    "invocation_growth_weekly": 8,
    "transaction_growth_weekly": 8,
    "native_contract_trends_by_users": 1,
    "native_contract_trends_by_interactions": 1,
    "evm_contract_trends_by_users": 2,
    "evm_contract_trends_by_interactions": 2,
}


@pytest.mark.parametrize("name", [n for n in CHECKS if n.endswith("__last_year")])
def test_period_reaches_every_fact_scan(spark, name):
    """Bounds arrive at all scans but the listed ones."""
    scans = _fact_scans(_plan(CHECKS[name].run(spark, SMALL)))
    open_ = [s for s in scans if not re.search("GreaterThanOrEqual|ScalarSubquery|subquery", s[1])]
    assert scans and len(open_) <= UNBOUNDED.get(name.removesuffix("__last_year"), 0), open_


def test_bounded_growth_reads_from_the_last_week_before(spark):
    """Both inputs of the distinct counts get the week as a bound at run time."""
    df = CHECKS["user_growth_weekly__last_year"].run(spark, MEDIUM)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"(l_shipdate#\d+) >= scalar-subquery", plan))) == 2


def test_bounded_trends_aggregate_the_history_of_winners_only(spark):
    for name in ("native_contract_trends_by_users", "evm_contract_trends_by_interactions"):
        nodes = _nodes(CHECKS[f"{name}__last_year"].run(spark, SMALL))
        for i, (depth, text) in enumerate(nodes):
            if text.startswith("FileScan parquet [l_") and "GreaterThanOrEqual" not in text:
                above, level = [], depth
                for d, t in reversed(nodes[:i]):
                    if d < level:
                        above.append(t)
                        level = d
                first = next(t for t in above if re.match("HashAggregate|.*Join", t))
                assert "Join" in first and "LeftSemi" in first


def test_unbounded_trends_scan_the_facts_once(spark):
    df = CHECKS["evm_contract_trends_by_users"].run(spark, MEDIUM)
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[l_", final)) == 1
    assert "ReusedExchange" in final


@pytest.mark.parametrize(
    "name,scans",
    [
        ("contract_deployments_split", 4),
        ("active_contracts_by_ledger", 4),
        ("contract_debuts_by_source", 4),
        ("weekly_evm_contracts_coa", 3),
    ],
)
def test_deployments_scan_logs_once_and_transactions_twice(spark, name, scans):
    df = CHECKS[name].run(spark, MEDIUM)
    df.collect()
    assert _plan(df).split("== Initial Plan ==")[0].count("FileScan parquet") == scans


@pytest.mark.parametrize("name", [n for n in BASE if "leaderboard" in n])
def test_leaderboards_are_a_top_k(spark, name):
    plan = _plan(CHECKS[name].run(spark, SMALL))
    assert "TakeOrderedAndProject(limit=10" in plan
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize(
    "name", ["evm_contract_trends_by_interactions", "contract_debuts_by_source", "deployers_over_time"]
)
def test_results_do_not_depend_on_partitioning(spark, name):
    expected = spark_rows(CHECKS[name].run(spark, MEDIUM))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        frame = CHECKS[name].run(spark, MEDIUM)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert difference(spark_rows(frame), expected) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_day_layout_prunes_partitions(spark, tmp_path):
    source = spark_ledger(spark, SMALL, "clicks")
    for name in ("evm_tx", "native_tx"):
        write_by_day(source[name], f"{tmp_path}/{name}", files_per_day=2)
    stored = Ledger.from_parquet(spark, str(tmp_path), genesis=date(2020, 1, 1))
    assert stored.evm_tx.filter(F.col("block_date").isNull()).count() == 0
    arguments = dict(period="last_week", as_of=date(2024, 1, 20))
    for name in ("transactions_over_time", "evm_transactions_kpi"):
        from_files = METRICS[name](stored, **arguments)
        assert "PartitionFilters: [isnotnull(block_date" in _plan(from_files)
        expected = METRICS[name](source, **arguments)
        assert difference(spark_rows(from_files), spark_rows(expected)) is None


def test_stored_deployments_read_little(spark, tmp_path):
    """Signatures reach the files, logs are pruned by day where they carry the time."""
    source = spark_ledger(spark, SMALL, "clicks")
    logs = source.evm_log.join(source.evm_tx.select("tx_hash", "block_timestamp"), "tx_hash")
    write_by_day(logs, f"{tmp_path}/evm_log", files_per_day=1)
    for name in ("evm_tx", "native_event"):
        write_by_day(source[name], f"{tmp_path}/{name}", files_per_day=1)
    arguments = dict(period="last_week", as_of=date(2024, 1, 20))
    expected = {
        name: spark_rows(METRICS[name](source, **arguments))
        for name in ("active_contracts_by_ledger", "contract_counts_over_time")
    }
    for shared in (False, True):
        stored = Ledger.from_parquet(
            spark, str(tmp_path), genesis=date(2020, 1, 1), shared_block_time=shared
        )
        for name, rows in expected.items():
            df = METRICS[name](stored, **arguments)
            plan = _plan(df)
            assert re.search(r"PushedFilters: \[[^\]]*In\(origin_function_signature", plan)
            assert "LeftOuter" not in plan
            log_scans = [s for s in re.findall(r"FileScan parquet [^\n]*", plan) if "topics" in s]
            assert log_scans
            assert all(("PartitionFilters: [isnotnull(block_date" in s) == shared for s in log_scans)
            assert difference(spark_rows(df), rows) is None
