"""Column helpers: ratios, running and trailing measures, row predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ledgerloom import constants as C


def order_nulls_last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def running(value: Column, order_by: str, partition_by: Sequence[str] = ()) -> Column:
    """Running total in ``order_by`` order.

    Meant for aggregated series (one row per bucket): without ``partition_by``
    Spark moves all rows to one partition, which is bounded by the bucket count.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_nulls_last(order_by))
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def trailing_mean(
    value: Column, order_by: str, partition_by: Sequence[str] = (), rows: int = 4
) -> Column:
    """Mean over the current row and the ``rows - 1`` rows before it."""
    w = Window.partitionBy(*partition_by).orderBy(*order_nulls_last(order_by))
    return F.avg(value).over(w.rowsBetween(1 - rows, Window.currentRow))


def trailing_quotient(value: Column, order_by: str, rows: int = 4) -> Column:
    """:func:`trailing_mean` of an exact value: its exact sum, divided at the end."""
    w = Window.orderBy(*order_nulls_last(order_by)).rowsBetween(1 - rows, Window.currentRow)
    return F.sum(value).over(w).cast("double") / F.count(value).over(w)


def previous(value: Column, order_by: str, partition_by: Sequence[str] = ()) -> Column:
    w = Window.partitionBy(*partition_by).orderBy(*order_nulls_last(order_by))
    return F.lag(value, 1).over(w)


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def non_zero(value: Column) -> Column:
    """``value``, or NULL where it is 0."""
    return F.when(value != 0, value)


def fixed_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of two counts with six decimals; NULL when the divisor is 0.

    The metrics divide whole numbers and then round. Doing that in fixed point
    keeps half-way digits from depending on binary fractions.
    """
    return F.round(_exact(numerator) / _exact(non_zero(denominator)), 6)


def pct_change(current: Column, before: Column) -> Column:
    """Change against ``before`` in percent; NULL without a usable ``before``."""
    return (fixed_ratio(current - before, before) * F.lit(100)).cast("decimal(30,4)")


def per_user(interactions: Column, users: Column) -> Column:
    """Interactions per user, rounded to two decimals."""
    return F.round(_exact(interactions) / _exact(non_zero(users)), 2).cast("decimal(20,2)")


def is_contract_call() -> Column:
    """EVM rows that are a successful call of a contract with call data."""
    return (
        F.col("tx_succeeded")
        & F.col("to_address").isNotNull()
        & F.col("input_data").isNotNull()
        & (F.col("input_data") != F.lit(C.EMPTY_CALL_DATA))
    )


def is_user_event() -> Column:
    """Native events of a successful transaction that name their sender."""
    return F.col("tx_succeeded") & F.col("event_from").isNotNull()


def label_of(name: Column, address: Column, overrides: Mapping[str, str]) -> Column:
    """Display name: listed name, else a fixed label, else the address."""
    label = F.lit(None).cast("string")
    for known, text in overrides.items():
        label = F.when(address == F.lit(known), F.lit(text)).otherwise(label)
    return F.coalesce(name, label, address)
