"""Top-k and first-seen operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_rows(df: DataFrame, by: str, k: int, tie_break: Sequence[str]) -> DataFrame:
    """The ``k`` rows with the largest ``by``.

    Sort plus limit, which Spark runs as a top-k per task and one small merge.
    ``tie_break`` makes the order total, so ties at rank ``k`` are stable.
    """
    order = [F.col(by).desc_nulls_first(), *(F.col(c).asc_nulls_last() for c in tie_break)]
    return df.orderBy(*order).limit(k)


def first_seen(df: DataFrame, key: str, when: Column, alias: str = "first_seen") -> DataFrame:
    """Earliest ``when`` per ``key``: one map-side-combined aggregate, no sort."""
    return df.groupBy(key).agg(F.min(when).alias(alias))
