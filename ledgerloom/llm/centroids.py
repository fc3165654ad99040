"""Centroid clustering of integer vectors; the nearest centroid is found by the threshold algorithm.

Every dimension has a list of the centroids in the order of their values there. A vector enters each
list at its own value and walks outward, the nearer side first. Centroids that come up anywhere get
their exact distance. What the lists show last, squared and summed over the dimensions, is a lower
bound for every centroid not yet seen; once it is strictly above the best distance, none of those
can be nearer or tie. All arithmetic is on integers, so results are exact and reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, stored

CLUSTERS = 16
ROUNDS = 3
COMPONENTS = 64
SCALE = 64
SEED = 1
ROWS = 1024


def largest(components: int) -> int:
    """The largest magnitude of a component with which every squared distance fits into 63 bits."""
    return math.isqrt((1 << 62) // components) // 2


def quantised(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)``: the vectors that are kept, as integers floor(scale * component).

    Vectors that are null, have another number of components or a component that is null, NaN or
    infinite are left out; so are those with a component so large that a squared distance may not
    fit into a long.
    """
    scaled = F.transform("embedding", lambda v: v.cast("double") * scale)
    bound = float(largest(components))
    fits = F.forall("_x", lambda v: F.coalesce(F.abs(v) < bound, F.lit(False)))  # NaN is above all numbers
    return (
        vectors.select("vec_id", scaled.alias("_x"))
        .filter((F.size("_x") == components) & fits)
        .select("vec_id", F.transform("_x", lambda v: F.floor(v).cast("int")).alias("x"))
    )


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``, fewer if there are fewer.

    Rows that share an id follow each other by their components; rows without an id come last.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(name.alias("name"), "x").orderBy(F.asc_nulls_last("name"), "x").limit(clusters).collect()
    return np.array([row["x"] for row in rows], dtype=np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, the smaller one of ties, and its squared distance.

    All vectors walk in step; one that has met its threshold leaves the walk.
    """
    count, dims = len(centroids), np.arange(centroids.shape[1])
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    far = np.int64(1) << 40  # beyond every distance in one dimension
    numbers = np.full(len(vectors), count, dtype=np.int64)
    distances = np.full(len(vectors), np.iinfo(np.int64).max, dtype=np.int64)
    walking = np.arange(len(vectors))
    right = np.stack([np.searchsorted(values[:, k], vectors[:, k]) for k in dims], axis=1)
    left = right - 1
    seen = np.zeros((len(vectors), count), dtype=bool)
    x = vectors
    for _ in range(count):  # after that, every list has shown every centroid
        if not len(walking):
            break
        below = np.where(left >= 0, x - values[left.clip(0), dims], far)
        above = np.where(right < count, values[right.clip(max=count - 1), dims] - x, far)
        down = below <= above
        frontier = np.where(down, below, above)
        shown = order[np.where(down, left, right), dims]
        left, right = left - down, right + ~down
        fresh = np.zeros_like(seen)
        np.put_along_axis(fresh, shown, True, axis=1)
        fresh &= ~seen
        seen |= fresh
        row, number = np.nonzero(fresh)
        exact = np.full(seen.shape, np.iinfo(np.int64).max, dtype=np.int64)
        exact[row, number] = ((x[row] - centroids[number]) ** 2).sum(axis=1)
        best = exact.argmin(axis=1)  # the smallest number of those that tie
        distance = exact[np.arange(len(x)), best]
        better = (distance < distances[walking]) | ((distance == distances[walking]) & (best < numbers[walking]))
        numbers[walking[better]] = best[better]
        distances[walking[better]] = distance[better]
        on = (frontier**2).sum(axis=1) <= distances[walking]
        walking, x, left, right, seen = walking[on], x[on], left[on], right[on], seen[on]
    return numbers, distances


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of the vectors nearest to it; unused ones stay.

    Tasks hand on one row of sums per centroid, never vectors.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=np.int64)
        for batch in portions(batches, ROWS):
            x = _matrix(batch)
            numbers, _ = nearest(x, centroids)
            np.add.at(sums[:, :-1], numbers, x)
            sums[:, -1] += np.bincount(numbers, minlength=len(centroids))
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(list(sums[used]), pa.list_(pa.int64()))],
            names=["cluster", "sums"],
        )

    totals = (
        kept.select("x")
        .mapInArrow(compute, "cluster int, sums array<bigint>")
        .select("cluster", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        .collect()  # clusters * (components + 1) rows
    )
    found = {(r["cluster"], r["place"]): int(r["total"]) for r in totals}
    width = centroids.shape[1]
    return np.array(
        [
            [found[c, k] // found[c, width] for k in range(width)] if (c, width) in found else list(centroids[c])
            for c in range(len(centroids))
        ],
        dtype=np.int64,
    )


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS,
    scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of every kept vector, stored, and the final centroids.

    Repeated rows and ids stay as they are and count as often as they occur. No kept vector gives
    no row and no centroid. Other columns of ``vectors`` are not read, whatever their names.
    """
    kept = stored(quantised(vectors, components, scale), "quantised")
    centroids = first_centroids(kept, clusters, seed)
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance").limit(0), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, ROWS):
            numbers, distances = nearest(_matrix(batch), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(numbers, pa.int32()), pa.array(distances, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    assigned = kept.mapInArrow(compute, f"vec_id {kind}, cluster int, distance bigint")
    return stored(assigned, "assigned"), centroids


def cluster_report(vectors: DataFrame, **options: int) -> DataFrame:
    """Columns vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    assigned, centroids = cluster_vectors(vectors, **options)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    totals = {r["cluster"]: int(r["total"]) for r in sums.collect()}  # one row per cluster
    rows = [
        (c, total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c, total in sorted(totals.items())
    ]
    named = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(totals.values())).cast("long").alias("inertia"),
        "centroid_sha256",
    )
