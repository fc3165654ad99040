"""Sharding by jump consistent hashing.

The shard follows from the key and the number of shards alone: no ring table, no state. Going from
n to n + 1 shards moves about 1 / (n + 1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positions, unit_hash

SLICES = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, after Lamping and Veach."""
    key = keys.astype(np.uint64)
    shard = np.full(len(key), -1, dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    moving = jump < shards
    while moving.any():
        shard[moving] = jump[moving]
        with np.errstate(over="ignore"):
            key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[moving] = np.floor((shard[moving] + 1) * step).astype(np.int64)
        moving = jump < shards
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column: the first 64 bits of the MD5 of its text; null counts as empty."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("int")
    def assign(digests: pd.Series) -> pd.Series:
        keys = np.fromiter((int(d[:16], 16) for d in digests), dtype=np.uint64, count=len(digests))
        return pd.Series(jump_hash(keys, shards).astype(np.int32))

    return assign(F.md5(F.coalesce(key.cast("string"), F.lit(""))))


def shard_documents(docs: DataFrame, shards: int = 16, slices: int = SLICES) -> DataFrame:
    """Put all ``docs`` into ``shards`` by the law ``key``: id and number of shards decide.

    Columns: doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, law, shard, slot and
    grown_shard (the shard with one more of them). Slots count from 0 without gaps in each shard,
    in the order of (MD5 of the id, id, size, checksum). Equal rows get slots of their own. Rows
    without an id share a shard. ``slices`` cuts each shard's ranking into as many tasks.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sized.select(
        "*",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        unit_hash(F.col("doc_id")).alias("_spread"),
    )
    ranked = positions(placed, ["shard"], "_spread", ["doc_id", "size", "text_crc32"], slices, "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
