"""Trailing measures over groups that may be too large for one task.

A window partitioned by a display name puts every row of that name into one
task. Names of contracts are not unique (thousands of proxies can share one),
so a popular name can hold most of the rows. Here each row gets its position
in the group from small per-slice counts, and neighbours meet by position in a
plain aggregate, which spreads over the cluster however large a group is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PERIOD, _SLICE, _AT, _BEFORE = "_period", "_slice", "_at", "_before"
_POS, _LAG, _TARGET = "_position", "_lag", "_target"


# "0x" and two hexadecimal digits: 256 slices of addresses.
PREFIX = 4


def slice_of(tie: Column, prefix: int = PREFIX) -> Column:
    """The first ``prefix`` characters of a tie-break value.

    Prefixes sort like the values, so the slices of an order are its parts.
    Never NULL, so that joining on it puts no extra filter on one branch of a
    plan and the branches can share their scan.
    """
    return F.coalesce(F.substring(tie, 1, prefix), F.lit(""))


def with_positions(
    df: DataFrame, group: str, period: str, tie: str, prefix: int = PREFIX
) -> DataFrame:
    """Number the rows of each ``group`` by ``period``, then ``tie``.

    Sorting happens inside ``(group, period, slice)``. Only the slice counts
    are summed up per group. ``prefix`` sets the number of slices (256 for
    hexadecimal addresses by default) and has no influence on the positions.
    ``group`` and ``tie`` must not be NULL; rows without a period come first.
    """
    keyed = df.withColumn(_SLICE, slice_of(F.col(tie), prefix)).withColumn(
        _PERIOD, F.coalesce(F.col(period).cast("string"), F.lit(""))
    )
    keys = [group, _PERIOD, _SLICE]
    numbered = keyed.withColumn(
        _AT, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(tie)))
    )
    earlier = (
        Window.partitionBy(group)
        .orderBy(_PERIOD, _SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        keyed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias(_BEFORE))
    )
    return numbered.join(offsets, keys).select(
        *df.columns, (F.col(_AT) + F.col(_BEFORE)).alias(_POS)
    )


def trailing_by_position(
    df: DataFrame,
    group: str,
    *,
    means: Mapping[str, Column],
    lags: Mapping[str, Column],
    rows: int = 4,
) -> DataFrame:
    """Add trailing means and previous values to rows numbered in ``group``.

    Every row is offered to its own position and the ``rows - 1`` after it; one
    aggregate per position then sees the row and its predecessors. Besides
    ``group``, ``df`` should only carry numbers and times, which Spark can
    aggregate by hash.
    """
    carried = [c for c in df.columns if c not in (group, _POS)]
    offered = df.withColumn(
        _LAG, F.explode(F.array(*(F.lit(i) for i in range(rows))))
    ).withColumn(_TARGET, F.col(_POS) + F.col(_LAG))
    lag = F.col(_LAG)
    return (
        offered.groupBy(group, _TARGET)
        .agg(
            F.count(F.when(lag == 0, 1)).alias("_present"),
            *(F.max(F.when(lag == 0, F.col(c))).alias(c) for c in carried),
            *(F.avg(value).alias(name) for name, value in means.items()),
            *(F.max(F.when(lag == 1, value)).alias(name) for name, value in lags.items()),
        )
        .filter(F.col("_present") > 0)
        .select(group, F.col(_TARGET).alias(_POS), *carried, *means, *lags)
    )
