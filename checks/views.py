"""Ledger-shaped views over the generated test tables.

The generated tables know nothing about blockchains. Each view below maps whole
tables, row by row, to one source table of the library. The text is shared by
Spark and DuckDB; only ``LIST(...)`` is spelled differently there.

The mapping is skewed on purpose: a third of the native events belong to the
fee contract, a third of the native transactions share one account, and many
EVM contracts share the empty name. Fees have cents; staked and locked amounts
and quotes are whole numbers, so that sums of doubles are exact in any order of
addition.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ledgerloom import constants as C
from ledgerloom.operators.deployments import evm_deployments
from ledgerloom.plans.growth import add_day_counts, add_day_keys
from ledgerloom.session import configure
from ledgerloom.sources import DayKeys, DayManifest, FirstSeen, Ledger, add_first_seen
from ledgerloom.sources.market import read_market_chart
from ledgerloom.sources.schemas import checked

DRIVER_SCHEMAS = {
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP"
    ),
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE",
}

_HASH = "'0x' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"

# Days to months of orders and shipments; block times are midnights.
CHAIN_VIEWS = {
    "native_tx": """
        SELECT CAST(o_orderkey AS STRING) AS tx_id, o_orderdate AS block_timestamp,
               CASE WHEN o_orderstatus = 'F' THEN LIST('service', CAST(o_custkey AS STRING))
                    WHEN o_orderpriority = '5-LOW' THEN LIST()
                    ELSE LIST(CAST(o_custkey AS STRING)) END AS authorizers
        FROM {orders}""",
    "native_event": f"""
        SELECT CAST(l_orderkey AS STRING) AS tx_id, l_shipdate AS block_timestamp,
               l_linestatus = 'F' AS tx_succeeded,
               CASE WHEN l_returnflag = 'R' THEN '{C.FEE_CONTRACT}'
                    WHEN l_quantity <= 25 THEN 'A.hot' || CAST(l_suppkey % 7 AS STRING)
                    ELSE 'A.' || CAST(l_suppkey AS STRING) || '.' || CAST(l_partkey % 25 AS STRING)
                    END AS event_contract,
               CASE WHEN l_returnflag = 'A' THEN '{C.CONTRACT_ADDED_EVENT}'
                    WHEN l_returnflag = 'R' AND l_quantity <= 45 THEN '{C.FEE_EVENT}'
                    ELSE 'Deposit' END AS event_type,
               CASE WHEN l_discount > 0 THEN CAST(l_partkey % 500 AS STRING) END AS event_from,
               CAST(l_extendedprice AS DOUBLE) AS event_amount
        FROM {{lineitem}}""",
    "native_actor": """
        SELECT CAST(o_orderkey AS STRING) AS tx_id, o_orderdate AS block_timestamp,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN LIST()
                    WHEN o_orderstatus = 'F' THEN LIST('service', CAST(o_custkey AS STRING))
                    WHEN o_orderpriority = '1-URGENT' THEN LIST(CAST(NULL AS STRING))
                    ELSE LIST(CAST(o_custkey AS STRING), CAST(o_custkey % 97 AS STRING))
                    END AS actors
        FROM {orders}""",
    "evm_tx": f"""
        SELECT {_HASH} AS tx_hash, l_shipdate AS block_timestamp,
               CASE WHEN l_quantity = 50 THEN NULL
                    WHEN l_suppkey % 4 = 0
                    THEN '{C.COA_PREFIX}' || CAST(l_orderkey % 1000 AS STRING)
                    ELSE '0xe' || CAST(l_orderkey % 1000 AS STRING) END AS from_address,
               CASE WHEN l_linenumber = 7 THEN NULL
                    WHEN l_quantity < 25 AND l_returnflag = 'A'
                    THEN '0xr' || CAST(l_suppkey % 5 AS STRING)
                    WHEN l_quantity < 25 THEN '0xc' || CAST(l_partkey % 40 AS STRING)
                    ELSE '0xc' || CAST(l_partkey AS STRING) END AS to_address,
               CAST(l_extendedprice AS DOUBLE) AS tx_fee, l_returnflag <> 'R' AS tx_succeeded,
               CASE WHEN l_quantity < 5 THEN '0x' WHEN l_quantity > 48 THEN NULL
                    ELSE '0x1234' END AS input_data,
               CASE l_linenumber WHEN 7 THEN '0x60806040' WHEN 6 THEN '0x60c06040'
                    ELSE '0xa9059cbb' END AS origin_function_signature
        FROM {{lineitem}}""",
    "evm_log": f"""
        SELECT {_HASH} AS tx_hash, '0xk' || CAST(l_partkey AS STRING) AS contract_address,
               CASE WHEN l_quantity = 1 THEN LIST()
                    WHEN l_partkey % 20 = 0 THEN LIST(upper('{C.OWNERSHIP_TOPIC}'), 'x')
                    WHEN l_partkey % 10 = 0 THEN LIST('{C.OWNERSHIP_TOPIC}')
                    ELSE LIST('0xddf252ad', '{C.OWNERSHIP_TOPIC}') END AS topics
        FROM {{lineitem}}""",
    "evm_contract": """
        SELECT '0xc' || CAST(p_partkey AS STRING) AS address,
               CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'PROMO' THEN '' ELSE p_name END AS name
        FROM {part}""",
    "staking_action": """
        SELECT o_orderdate AS block_timestamp,
               CASE o_orderstatus WHEN 'F' THEN 'TokensCommitted'
                    WHEN 'O' THEN 'UnstakedTokensWithdrawn'
                    ELSE 'DelegatorTokensCommitted' END AS action,
               CAST(floor(o_totalprice) AS DOUBLE) AS amount
        FROM {orders}""",
    "protocol_tvl": """
        SELECT CAST(l_shipdate AS DATE) AS date,
               CASE WHEN l_suppkey % 3 = 0 THEN 'Ethereum' ELSE 'flow-main' END AS chain,
               CASE l_linenumber WHEN 1 THEN 'Staking Pool' WHEN 2 THEN 'Liquid Staking'
                    WHEN 3 THEN 'Lending' WHEN 4 THEN 'Services' WHEN 5 THEN 'Derivatives'
                    WHEN 6 THEN 'Launchpad' ELSE 'Dexes' END AS category,
               CAST(floor(l_extendedprice) AS DOUBLE) AS chain_tvl
        FROM {lineitem}""",
    "quotes": """
        SELECT o_orderdate AS date, CAST(max(floor(o_totalprice)) AS DOUBLE) AS price,
               CAST(sum(floor(o_totalprice)) AS DOUBLE) AS market_cap,
               CAST(count(*) AS DOUBLE) AS volume
        FROM {orders} GROUP BY o_orderdate""",
}

# One month of clicks with sub-second block times, for hourly buckets.
CLICK_VIEWS = {
    "native_tx": """
        SELECT 'n' || CAST(event_id AS STRING) AS tx_id, ts AS block_timestamp,
               LIST(CAST(user_id AS STRING)) AS authorizers
        FROM {events}""",
    "native_event": f"""
        SELECT 'n' || CAST(event_id AS STRING) AS tx_id, ts AS block_timestamp,
               event_type <> 'error' AS tx_succeeded,
               CASE event_type WHEN 'purchase' THEN '{C.FEE_CONTRACT}'
                    ELSE 'A.' || event_type || CAST(user_id % 9 AS STRING) END AS event_contract,
               CASE event_type WHEN 'purchase' THEN '{C.FEE_EVENT}'
                    WHEN 'signup' THEN '{C.CONTRACT_ADDED_EVENT}' ELSE 'Deposit' END AS event_type,
               CAST(user_id AS STRING) AS event_from,
               round(value, 2) AS event_amount
        FROM {{events}}""",
    "native_actor": """
        SELECT 'n' || CAST(event_id AS STRING) AS tx_id, ts AS block_timestamp,
               LIST(CAST(user_id AS STRING), event_type) AS actors
        FROM {events}""",
    "evm_tx": f"""
        SELECT '0x' || CAST(event_id AS STRING) AS tx_hash, ts AS block_timestamp,
               CASE WHEN user_id % 3 = 0 THEN '{C.COA_PREFIX}' ELSE '0xe' END
               || CAST(user_id AS STRING) AS from_address,
               '0xc' || CAST(user_id % 10 AS STRING) AS to_address,
               round(value, 2) AS tx_fee, event_type <> 'error' AS tx_succeeded, '0x1234' AS input_data,
               CASE WHEN event_type = 'signup' THEN '0x60806040' ELSE '0xa9059cbb' END
               AS origin_function_signature
        FROM {{events}}""",
    "evm_log": f"""
        SELECT '0x' || CAST(event_id AS STRING) AS tx_hash,
               '0xk' || CAST(user_id AS STRING) AS contract_address,
               CASE WHEN event_type = 'click' OR user_id % 5 = 0
                    THEN LIST('{C.OWNERSHIP_TOPIC}') ELSE LIST('0xddf252ad') END AS topics
        FROM {{events}}""",
    "evm_contract": """
        SELECT DISTINCT '0xc' || CAST(user_id % 10 AS STRING) AS address,
               CASE user_id % 10 WHEN 3 THEN NULL ELSE 'pool' || CAST(user_id % 2 AS STRING) END
               AS name
        FROM {events}""",
}

# The chain with calls of unlisted contracts that only have a fixed label.
_LABELLED = dict(enumerate(C.LABELS_WELL_KNOWN))
_TARGET = "'0xc' || CAST(l_partkey % 40 AS STRING)"
LABELLED_VIEWS = CHAIN_VIEWS | {
    "evm_tx": CHAIN_VIEWS["evm_tx"].replace(
        _TARGET,
        "CASE l_partkey % 40 "
        + " ".join(f"WHEN {i} THEN '{address}'" for i, address in _LABELLED.items())
        + f" ELSE {_TARGET} END",
    )
}
assert LABELLED_VIEWS["evm_tx"] != CHAIN_VIEWS["evm_tx"]

# Events of the chain with sender and amount still inside JSON text: present, explicit null or
# missing. The statements for DuckDB keep the typed columns.
RAW_EVENTS = """
    SELECT tx_id, block_timestamp, tx_succeeded, event_contract, event_type,
           CASE WHEN event_from IS NOT NULL
                THEN concat(chr(123), '"from": "', event_from, '", "amount": ', event_amount, chr(125))
                WHEN tx_succeeded THEN concat(chr(123), '"from": null, "amount": ', event_amount, chr(125))
                ELSE concat(chr(123), '"amount": ', event_amount, chr(125)) END AS event_data
    FROM {events}"""

WORLDS = {
    "chain": (CHAIN_VIEWS, date(2001, 8, 1), date(1995, 1, 1)),
    "labelled": (LABELLED_VIEWS, date(2001, 8, 1), date(1995, 1, 1)),
    "raw": (CHAIN_VIEWS, date(2001, 8, 1), date(1995, 1, 1)),
    "json": (CHAIN_VIEWS, date(2001, 8, 1), date(1995, 1, 1)),
    "clicks": (CLICK_VIEWS, date(2024, 1, 31), date(2020, 1, 1)),
    # On a Monday, the last day lies before the current week.
    "monday": (CLICK_VIEWS, date(2024, 1, 29), date(2020, 1, 1)),
}


def duckdb_ctes(world: str, names: list[str]) -> str:
    """The views as a DuckDB ``WITH`` list over the registered tables."""
    views = WORLDS[world][0]
    tables = {t: t for t in DRIVER_SCHEMAS}
    return ",\n".join(
        f"{n} AS ({views[n].format(**tables).replace('LIST(', 'list_value(')})" for n in names
    )


def _market_chart(quotes: DataFrame) -> DataFrame:
    """Daily quotes as one market-chart document; one array entry per day."""
    return quotes.sparkSession.sql(
        """
        SELECT named_struct(
            'prices', collect_list(array(ms, price)),
            'market_caps', collect_list(array(ms, market_cap)),
            'total_volumes', collect_list(array(ms, volume))) AS data
        FROM (SELECT CAST(unix_millis(date) AS DOUBLE) AS ms, * FROM {quotes})""",
        quotes=quotes,
    )


def _as_snapshot(chart: DataFrame) -> DataFrame:
    """The chart written as a JSON document and read as a snapshot."""
    spark = chart.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    path = f"{folder}/market-chart-{uuid.uuid4().hex}"
    chart.write.json(path)
    return read_market_chart(spark, path)


def _with_state(spark: SparkSession, ledger: Ledger) -> Ledger:
    """``ledger`` with a first-seen state and a manifest built from all its days."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    path = f"{folder}/state-{uuid.uuid4().hex}"
    state, manifest = FirstSeen(spark, f"{path}/first-seen"), DayManifest(spark, f"{path}/manifest")
    add_first_seen(state, ledger, evm_deployments)
    add_day_counts(manifest, ledger)
    ledger.first_seen, ledger.manifest = state, manifest
    return ledger


def _with_day_keys(spark: SparkSession, ledger: Ledger) -> Ledger:
    """``ledger`` with a manifest and the keys of its days."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    path = f"{folder}/state-{uuid.uuid4().hex}"
    ledger.manifest, ledger.day_keys = DayManifest(spark, f"{path}/manifest"), DayKeys(spark, f"{path}/keys")
    add_day_counts(ledger.manifest, ledger)
    add_day_keys(ledger.day_keys, ledger)
    return ledger


def spark_ledger(spark: SparkSession, sf_dir: str, world: str = "chain", **options) -> Ledger:
    """The views over the Parquet files in ``sf_dir``, as a ledger.

    ``state=True`` adds the first-seen state and the manifest that are kept beside the facts,
    ``day_keys=True`` the manifest and the keys of days.
    """
    state, day_keys = options.pop("state", False), options.pop("day_keys", False)
    configure(spark)
    views, _, genesis = WORLDS[world]

    @cache
    def table(name: str) -> DataFrame:
        return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    def view(name: str) -> DataFrame:
        text = views[name]
        used = {t: table(t) for t in DRIVER_SCHEMAS if "{%s}" % t in text}
        return spark.sql(text.replace("LIST(", "array("), **used)

    def opener(name: str) -> DataFrame:
        if name == "market_chart":
            chart = _market_chart(view("quotes"))
            return _as_snapshot(chart) if world == "json" else chart
        if name == "native_event" and world == "raw":
            return checked(spark.sql(RAW_EVENTS, events=view(name)), name)
        return view(name)

    ledger = Ledger(opener, genesis=genesis, **options)
    if day_keys:
        return _with_day_keys(spark, ledger)
    return _with_state(spark, ledger) if state else ledger
