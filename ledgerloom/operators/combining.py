"""Ways to put aggregated frames side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_totals(*totals: DataFrame) -> DataFrame:
    """One row out of several one-row totals with different columns."""
    merged = stack(*totals)
    return merged.agg(*(F.max(c).alias(c) for c in merged.columns))


def align(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join of two bucket series; missing measures become 0."""
    joined = left.join(right, on, "full")
    measures = [c for c in joined.columns if c != on]
    return joined.select(on, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in measures))


def having_key(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` occurs in ``keys``: a skew-proof semi join.

    Copies of a key are combined before they are shuffled. Grouping by a
    derived second key makes the join shuffle the keys again, which is cheap
    and leaves both of its sides straight from a shuffle: adaptive execution
    can then split a key that fills a partition of ``df``.
    """
    distinct = keys.select(on, F.length(on).alias("_width")).distinct().select(on)
    return df.join(distinct, on, "left_semi")
