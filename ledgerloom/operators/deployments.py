"""EVM contract deployments, the sub-plan behind the deployment metrics.

A deployment shows up in one of two ways: a log that announces an ownership
transfer (the log's address is the contract), or, for transactions without
such a log, a constructor signature (the transaction hash stands in for the
contract).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions.periods import Span, within
from ledgerloom.operators.combining import having_key
from ledgerloom.sources.ledger import Ledger


def is_marker(topic: str = C.OWNERSHIP_TOPIC) -> Column:
    """Log rows whose first topic is ``topic`` in any letter case."""
    return F.coalesce(F.get(F.col("topics"), F.lit(0)).ilike(f"%{topic}%"), F.lit(False))


def is_constructor(signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES) -> Column:
    return F.col("origin_function_signature").isin(*signatures)


def marker_logs(ledger: Ledger, span: Span, topic: str = C.OWNERSHIP_TOPIC) -> DataFrame:
    """Distinct ``(tx_hash, contract)`` pairs of marker logs.

    Over all time, unless logs carry the block time of their transactions.
    Filtered and de-duplicated before any join, so one noisy transaction
    reaches the join with one row per contract.
    """
    return (
        ledger.partner("evm_log", span)
        .filter(is_marker(topic) & F.col("tx_hash").isNotNull())
        .select("tx_hash", F.col("contract_address").alias("contract"))
        .distinct()
    )


def _marked_hashes(markers: DataFrame) -> DataFrame:
    """One row per marked hash.

    Counting keeps the marker set itself below it, so that its readers share
    one scan and one shuffle. The second, derived key makes joins shuffle this
    side themselves: adaptive execution can only split a hot hash where both
    sides of a join come straight from a shuffle.
    """
    return (
        markers.groupBy("tx_hash", F.length("tx_hash").alias("width"))
        .agg(F.count(F.lit(1)).alias("contracts"))
        .filter("contracts > 0")
        .select("tx_hash")
    )


def _announced(ledger: Ledger, span: Span, markers: DataFrame, *columns: Column) -> DataFrame:
    """Marker contracts with the columns of their transactions.

    Transactions are first reduced to marked hashes, without copies; only then
    does each meet its contracts.
    """
    rows = within(ledger.evm_tx, span).select("tx_hash", *columns)
    marked = rows.join(_marked_hashes(markers), "tx_hash", "left_semi")
    return marked.distinct().join(markers, "tx_hash")


def _constructors(
    ledger: Ledger, span: Span, signatures: Sequence[str], *columns: Column
) -> DataFrame:
    """Transactions with a constructor signature and a hash, without copies."""
    return (
        within(ledger.evm_tx, span)
        .filter(is_constructor(signatures) & F.col("tx_hash").isNotNull())
        .select("tx_hash", *columns)
        .distinct()
    )


def evm_deployments(
    ledger: Ledger,
    span: Span,
    *,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """Distinct ``(bucket, creator, contract)`` of deployments inside ``span``.

    Two narrow scans of the transactions: those with a marker log, by a join
    that keeps little, and those with a constructor signature, by a filter that
    reaches the files. The second kind counts without any marker log of all
    time; the row being tested is itself the transaction the log belongs to.
    """
    markers = marker_logs(ledger, span, topic)
    columns = span.bucket().alias("bucket"), F.col("from_address").alias("creator")
    announced = _announced(ledger, span, markers, *columns)
    constructors = _constructors(ledger, span, signatures, *columns)
    alone = constructors.join(_marked_hashes(markers), "tx_hash", "left_anti")
    return (
        announced.select("bucket", "creator", "contract")
        .union(alone.select("bucket", "creator", "tx_hash"))
        .distinct()
    )


def evm_contracts_or_transactions(
    ledger: Ledger,
    span: Span,
    *,
    topic: str = C.OWNERSHIP_TOPIC,
    signatures: Sequence[str] = C.CONSTRUCTOR_SIGNATURES,
) -> DataFrame:
    """``(bucket, contract)`` where both signs of a deployment may count.

    Unlike :func:`evm_deployments`, a constructor transaction adds its hash
    unless every one of its logs is a marker, so a transaction with a marker
    and another log adds an address and a hash. The logs are reduced to those
    of constructor transactions before they are looked at as groups.
    """
    bucket = span.bucket().alias("bucket")
    announced = _announced(ledger, span, marker_logs(ledger, span, topic), bucket)
    constructors = _constructors(ledger, span, signatures, bucket)
    logs = ledger.partner("evm_log", span).select("tx_hash", is_marker(topic).alias("marker"))
    only_markers = (
        having_key(logs, constructors, "tx_hash")
        .groupBy("tx_hash")
        .agg(F.bool_and("marker").alias("only_markers"))
        .filter("only_markers")
    )
    alone = constructors.join(only_markers, "tx_hash", "left_anti")
    return announced.select("bucket", "contract").union(alone.select("bucket", "tx_hash"))
