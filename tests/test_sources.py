import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.compare import difference, spark_rows
from checks.views import spark_ledger
from ledger_rows import at, rows_of
from ledgerloom import METRICS, Ledger
from ledgerloom.sources import TABLES, market_points, read_market_chart, save_bucketed

SMALL = "/root/testdata/sf0.001"


def test_market_chart_snapshot(spark, tmp_path):
    midnight, later = 1715731200000, 1715765400123
    document = {
        "status_code": 200,
        "data": {
            "prices": [[midnight, 0.5], [later, 0.75]],
            "market_caps": [[midnight, 1e9]],
            "total_volumes": [],
        },
    }
    (tmp_path / "chart.json").write_text(json.dumps(document, indent=1))
    chart = read_market_chart(spark, str(tmp_path))
    points = rows_of(market_points(chart, days=30, as_of=date(2024, 5, 15)))
    assert [(p["series"], p["date"], p["value"]) for p in points] == [
        ("prices", at("2024-05-15T00:00:00"), 0.5),
        ("prices", at("2024-05-15T09:30:00.123000"), 0.75),
        ("market_caps", at("2024-05-15T00:00:00"), 1e9),
    ]
    assert rows_of(market_points(chart, days=30, as_of=date(2024, 5, 14))) == []


def test_catalog_tables_with_raw_event_data(spark):
    spark.sql(
        """SELECT 'a' AS tx_id, timestamp'2024-05-07' AS block_timestamp, TRUE AS tx_succeeded,
                  'A.x' AS event_contract, 'Deposit' AS event_type,
                  parse_json('{"from": "0x1", "amount": "2.5"}') AS event_data"""
    ).createOrReplaceTempView("raw_events")
    ledger = Ledger.from_catalog(spark, {"native_event": "raw_events"})
    (row,) = rows_of(ledger.native_event)
    assert (row["event_from"], row["event_amount"]) == ("0x1", 2.5)
    (board,) = rows_of(
        METRICS["native_contract_leaderboard_by_users"](
            ledger, period="last_week", as_of=date(2024, 5, 10), min_users=1
        )
    )
    assert board["contract_name"] == "A.x"


def test_ledger_opens_tables_once_and_knows_its_names(spark):
    opened = []

    def opener(name):
        opened.append(name)
        return spark.createDataFrame([], TABLES[name])

    ledger = Ledger(opener)
    assert ledger.evm_tx is ledger["evm_tx"]
    assert opened == ["evm_tx"]
    with pytest.raises(AttributeError):
        ledger.blocks


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    source = spark_ledger(spark, SMALL, "clicks")
    names = {"native_tx": "tx_id", "native_event": "tx_id"}
    for name, key in names.items():
        save_bucketed(
            source[name], f"bucketed_{name}", key=key, buckets=4, path=f"{tmp_path}/{name}"
        )
    try:
        stored = Ledger.from_catalog(spark, {n: f"bucketed_{n}" for n in names})
        arguments = dict(as_of=date(2024, 1, 31), threshold=3)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        name = "native_contracts_over_tx_threshold"
        df = METRICS[name](stored, **arguments)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Only the weekly count and the final order move rows.
        assert plan.count("Exchange hashpartitioning") == 1
        assert plan.count("Exchange rangepartitioning") == 1
        assert difference(spark_rows(df), spark_rows(METRICS[name](source, **arguments))) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE bucketed_{name}")


def test_parquet_with_raw_event_data_is_parsed(spark, tmp_path):
    rows = [
        ("t", True, "A.x", "Deposit", '{"from": "a", "amount": 1.5}'),
        ("t", True, "A.x", "Deposit", '{"from": null, "amount": 2}'),
        ("t", True, "A.x", "Deposit", '{"amount": "3"}'),
    ]
    columns = "tx_id string, tx_succeeded boolean, event_contract string, event_type string, event_data string"
    raw = spark.createDataFrame(rows, columns).withColumn("block_timestamp", F.current_timestamp())
    raw.write.parquet(f"{tmp_path}/native_event")
    ledger = Ledger.from_parquet(spark, str(tmp_path))
    found = {(r.event_from, r.event_amount) for r in ledger.native_event.collect()}
    assert found == {("a", 1.5), (None, 2.0), (None, 3.0)}


@pytest.mark.parametrize("dropped", ["event_data", "tx_id"])
def test_missing_columns_raise(spark, tmp_path, dropped):
    raw = spark.range(1).selectExpr(
        "'t' as tx_id", "current_timestamp() as block_timestamp", "true as tx_succeeded",
        "'c' as event_contract", "'e' as event_type", "'{}' as event_data",
    )
    raw.drop(dropped).write.parquet(f"{tmp_path}/native_event")
    with pytest.raises(ValueError, match="lacks the columns"):
        Ledger.from_parquet(spark, str(tmp_path)).native_event
