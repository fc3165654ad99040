"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, stored


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (columns a, b); root is the smallest node.

    Alternates large-star and small-star steps (Kiveris et al.): every step hangs the neighbours of
    a node onto the smallest one, so that after a logarithmic number of rounds each component is a
    star around its smallest node. Only links move, by joins that split hot nodes; each round is
    written to the shared folder. ``rows``, if known, is the number of links.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = stored((edges if rows is None else compact(edges, rows, "hi")).distinct(), "links")
    before = _sum(edges)
    while True:
        count = before[0]
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = compact(both, 2 * count, "hi").groupBy("hi").agg(F.min("lo").alias("least"))
        least = least.select(F.col("hi"), F.least("hi", "least").alias("least"))
        # Larger neighbours of each node go to the least one around it.
        large = (
            edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
            .join(least.withColumnRenamed("hi", "node"), "node")
            .select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        )
        large = stored(compact(large, count, "hi").distinct(), "large-star")
        # Smaller neighbours of each node, and the node itself, go to the least of them.
        least = compact(large, count, "hi").groupBy("hi").agg(F.min("lo").alias("least"))
        small = (
            large.join(least, "hi")
            .select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
            .unionByName(least.select("hi", F.col("least").alias("lo")))
            .filter("hi <> lo")
        )
        edges = stored(compact(small, 2 * count, "hi").distinct(), "small-star")
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def _sum(edges: DataFrame) -> tuple:
    """Number of links and an order-free checksum of them."""
    hashed = F.xxhash64("hi", "lo")
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 16))
    ).first()
    return tuple(row)
