"""One transaction, name or account that holds a large part of all rows."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledger_rows import at, rows_of
from ledgerloom import METRICS, Ledger
from ledgerloom import constants as C
from ledgerloom.functions.periods import Span
from ledgerloom.operators.deployments import evm_contracts_or_transactions, evm_deployments
from ledgerloom.operators.sequences import trailing_by_position, with_positions

TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
}


@pytest.fixture
def tight(spark):
    for key, value in TIGHT.items():
        spark.conf.set(key, value)
    yield spark
    for key in TIGHT:
        spark.conf.unset(key)


def _hot_ledger(spark, rows=60_000, contracts=40):
    """A third of all transaction rows are one hash with many marker logs."""
    base = spark.range(0, rows, 1, 8)
    hot = F.col("id") % 3 == 0
    evm_tx = base.select(
        F.when(hot, F.lit("0xhot")).otherwise(F.concat(F.lit("0x"), "id")).alias("tx_hash"),
        F.timestamp_seconds(F.lit(1714521600) + F.col("id") % 864000).alias("block_timestamp"),
        F.concat(F.lit("0xa"), (F.col("id") % 50).cast("string")).alias("from_address"),
        F.when(F.col("id") % 7 == 0, "0x60806040").otherwise("0xa9059cbb").alias(
            "origin_function_signature"
        ),
    )
    evm_log = base.select(
        F.when(hot, F.lit("0xhot")).otherwise(F.concat(F.lit("0x"), "id")).alias("tx_hash"),
        F.concat(F.lit("0xk"), (F.col("id") % contracts).cast("string")).alias("contract_address"),
        F.array(F.when(hot | (F.col("id") % 11 == 0), C.OWNERSHIP_TOPIC).otherwise("0xddf")).alias(
            "topics"
        ),
    )
    return Ledger.from_frames({"evm_tx": evm_tx, "evm_log": evm_log})


def test_hot_transaction_is_split_and_complete(tight):
    ledger = _hot_ledger(tight)
    df = evm_deployments(ledger, Span(grain="day"))
    got = {(r["bucket"], r["creator"], r["contract"]) for r in rows_of(df)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin\(skew=true\).*LeftSemi", plan)

    tx, logs = ledger.evm_tx.toPandas(), ledger.evm_log.toPandas()
    tx["bucket"] = tx.block_timestamp.dt.floor("D")
    marked = logs[[t[0] == C.OWNERSHIP_TOPIC for t in logs.topics]]
    marked = marked[["tx_hash", "contract_address"]].drop_duplicates()
    senders = tx[["tx_hash", "bucket", "from_address"]].drop_duplicates()
    joined = senders.merge(marked, on="tx_hash")
    expected = set(zip(joined.bucket, joined.from_address, joined.contract_address))
    silent = tx[
        (tx.origin_function_signature == "0x60806040") & ~tx.tx_hash.isin(marked.tx_hash)
    ]
    expected |= set(zip(silent.bucket, silent.from_address, silent.tx_hash))
    assert got == expected


def test_rows_before_joins_do_not_grow_with_copies(tight):
    """A hot hash reaches the expanding join once per sender and bucket."""
    ledger = _hot_ledger(tight, rows=30_000)
    evm_deployments(ledger, Span(grain="month")).collect()
    df = evm_contracts_or_transactions(ledger, Span(grain="month"))
    assert df.filter(F.col("contract").startswith("0xk")).count() < 30_000


def test_hot_native_transaction_in_a_semi_join(tight):
    base = tight.range(0, 60_000, 1, 8)
    tx_id = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    time = F.timestamp_seconds(F.lit(1714521600) + F.col("id")).alias("block_timestamp")
    account = F.concat(F.lit("u"), (F.col("id") % 777).cast("string"))
    kind = F.when((F.col("id") % 3 == 0) | (F.col("id") % 5 == 0), C.CONTRACT_ADDED_EVENT)
    ledger = Ledger.from_frames(
        {
            "native_tx": base.select(tx_id.alias("tx_id"), time, F.array(account).alias("authorizers")),
            "native_event": base.select(tx_id.alias("tx_id"), time, kind.alias("event_type")),
        }
    )
    df = METRICS["native_deployers_kpi"](ledger, period="last_month", as_of=date(2024, 5, 16))
    (row,) = rows_of(df)
    assert row["total_cadence_deployers"] == len(
        {i % 777 for i in range(60_000) if i % 3 == 0 or i % 5 == 0}
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin\(skew=true\).*LeftSemi", plan)


def _brute_force(rows):
    """Trailing means and previous values over a plain sorted list."""
    out, by_name = [], {}
    for r in sorted(rows, key=lambda r: (r["name"], r["week"], r["address"])):
        by_name.setdefault(r["name"], []).append(r)
    for name, sequence in by_name.items():
        for i, r in enumerate(sequence):
            last = [s["users"] for s in sequence[max(0, i - 3) : i + 1]]
            before = sequence[i - 1]["users"] if i else -1
            out.append((name, r["week"], r["users"], sum(last) / len(last), before))
    return out


@pytest.mark.parametrize("seed,prefix", [(1, 4), (2, 3), (2, 0), (2, 20)])
def test_positions_equal_one_big_sort(spark, seed, prefix):
    rng = random.Random(seed)
    rows = {
        (name, date(2024, 1, 1) + timedelta(weeks=week), f"0x{rng.randrange(10**6)}")
        for name, count in (("hot", 900), ("warm", 40), ("", 10), ("one", 1))
        for _ in range(count)
        for week in [rng.randrange(6)]
    }
    frame = spark.createDataFrame(
        [(*r, rng.randrange(100)) for r in sorted(rows)],
        "name STRING, week DATE, address STRING, users BIGINT",
    ).repartition(8)
    listed = rows_of(frame)
    result = trailing_by_position(
        with_positions(frame, "name", "week", "address", prefix).drop("address"),
        "name",
        means={"mean": F.col("users")},
        lags={"before": F.col("users")},
    )
    got = sorted((r["name"], r["week"], r["users"], r["mean"], -1 if r["before"] is None else r["before"]) for r in rows_of(result))
    assert got == sorted(_brute_force(listed))


def test_hot_fee_transaction_is_weighted_not_expanded(spark):
    n, m = 4_000, 3_000
    native_tx = spark.range(n).select(
        F.lit("hot").alias("tx_id"), F.lit(at("2024-05-07")).cast("timestamp").alias("block_timestamp")
    )
    native_event = spark.range(m).select(
        F.lit("hot").alias("tx_id"),
        F.lit(at("2024-05-07")).cast("timestamp").alias("block_timestamp"),
        F.lit(C.FEE_CONTRACT).alias("event_contract"),
        F.lit(C.FEE_EVENT).alias("event_type"),
        F.lit(0.5).alias("event_amount"),
    )
    evm_tx = native_tx.select("block_timestamp", F.lit(1.0).alias("tx_fee")).limit(0)
    ledger = Ledger.from_frames(
        {"native_tx": native_tx, "native_event": native_event, "evm_tx": evm_tx}
    )
    df = METRICS["fees_over_time"](ledger, period="last_year", as_of=date(2024, 5, 16))
    (row,) = rows_of(df)
    assert (row["flow_fees"], row["avg_tx_flow_fee"]) == (n * m * 0.5, 0.5)
