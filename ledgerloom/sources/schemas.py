"""Schemas of the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    StringType,
    StructField,
    StructType,
    TimestampType,
    VariantType,
)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_TEXT, _TIME, _NUM, _FLAG = StringType(), TimestampType(), DoubleType(), BooleanType()
_PAIRS = ArrayType(ArrayType(_NUM))

MARKET_CHART = _table(data=_table(prices=_PAIRS, market_caps=_PAIRS, total_volumes=_PAIRS))

TABLES: dict[str, StructType] = {
    "native_tx": _table(tx_id=_TEXT, block_timestamp=_TIME, authorizers=ArrayType(_TEXT)),
    "native_event": _table(
        tx_id=_TEXT,
        block_timestamp=_TIME,
        tx_succeeded=_FLAG,
        event_contract=_TEXT,
        event_type=_TEXT,
        event_from=_TEXT,
        event_amount=_NUM,
    ),
    "native_actor": _table(tx_id=_TEXT, block_timestamp=_TIME, actors=ArrayType(_TEXT)),
    "evm_tx": _table(
        tx_hash=_TEXT,
        block_timestamp=_TIME,
        from_address=_TEXT,
        to_address=_TEXT,
        tx_fee=_NUM,
        tx_succeeded=_FLAG,
        input_data=_TEXT,
        origin_function_signature=_TEXT,
    ),
    "evm_log": _table(tx_hash=_TEXT, contract_address=_TEXT, topics=ArrayType(_TEXT)),
    "evm_contract": _table(address=_TEXT, name=_TEXT),
    "staking_action": _table(block_timestamp=_TIME, action=_TEXT, amount=_NUM),
    "protocol_tvl": _table(date=DateType(), chain=_TEXT, category=_TEXT, chain_tvl=_NUM),
    "market_chart": MARKET_CHART,
}

# Columns that a stored table may have besides; plans use them where they are.
OPTIONAL: dict[str, dict] = {"evm_log": {"block_timestamp": _TIME}}

# Tables that grow with the chain and carry a block time.
FACT_TABLES = ("native_tx", "native_event", "native_actor", "evm_tx", "staking_action")


def checked(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of table ``name``, raw ``event_data`` unpacked.

    Columns that are missing raise ``ValueError`` instead of turning to NULL.
    Further columns stay only if they are known: optional ones and the
    partition column ``block_date``.
    """
    if name == "native_event" and "event_data" in df.columns:
        df = parse_event_data(df)
    missing = [f.name for f in TABLES[name] if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {name!r} lacks the columns {missing}")
    further = [c for c in (*OPTIONAL.get(name, {}), "block_date") if c in df.columns]
    return df.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]), *further
    )


def parse_event_data(df: DataFrame) -> DataFrame:
    """Unpack ``event_data`` (VARIANT or JSON text) into typed columns.

    Adds ``event_from`` and ``event_amount``; a missing path and an explicit
    JSON null both become NULL. Frames that already have the columns pass.
    """
    if "event_from" in df.columns and "event_amount" in df.columns:
        return df
    data = F.col("event_data")
    if not isinstance(df.schema["event_data"].dataType, VariantType):
        data = F.try_parse_json(data)
    return df.withColumn("event_from", F.try_variant_get(data, "$.from", "string")).withColumn(
        "event_amount", F.try_variant_get(data, "$.amount", "double")
    )
