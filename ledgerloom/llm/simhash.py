"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a value between them that differs from each
in at most one. So every distinct fingerprint emits itself and its 64 one-bit variants, the variants
are grouped, and whoever meets at one is a pair. A group has 65 possible members, one per flipped
bit; one bit mask holds them all, so groups need no lists and partial aggregation works.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, row_key, stored, without_rows
from .components import connected_components

SEED = 42
BITS = 64
PIECE = 1 << 20
VARIANTS_A_TASK = 500_000
WHITE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def word_pieces(text: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about a megabyte; each carries the last words before it,
    so that every run of ``shingle`` words lies whole in exactly one piece."""
    text = text.translate(LOWER)
    if len(text) <= PIECE:
        yield text.split()
        return
    carry: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in WHITE:
            end += 1
        words = carry + text[at:end].split()
        yield words
        carry = words[len(words) - shingle + 1 :] if shingle > 1 else []
        at = end


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``shingle`` words, repeats included; of all words if there are fewer."""
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    fewer: list[bytes] = []
    done = False
    for words in word_pieces(text, shingle):
        count = len(words) - shingle + 1
        if count > 0:
            runs = zip(*(words[i:] for i in range(shingle)), strict=False)
            yield np.fromiter(map(hashed, map(b" ".join, runs)), dtype=np.uint64, count=count)
            done = True
        else:
            fewer = words
    if not done and fewer:
        yield np.array([hashed(b" ".join(fewer))], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if it is set in more than half of the hashes; no words give 0."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, along: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``along`` and fp: the fingerprint of each text as a signed 64-bit number; null is empty."""
    texts = docs.select(*along, F.coalesce("text", F.lit("")).cast("binary").alias("_bytes"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, raws = batch.columns
            found = [fingerprint(raw.as_py(), shingle) for raw in raws]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.int64())], names=[*along, "fp"])

    kinds = [f"{name} {texts.schema[name].dataType.simpleString()}" for name in along]
    return texts.mapInArrow(compute, ", ".join([*kinds, "fp bigint"]))


def balls(values: DataFrame, bits: int = BITS, keys: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """Where values within two bits of each other meet: one row per variant with two values or more.

    ``values`` has distinct values in column fp (and ``keys``, inside which they meet). Columns:
    keys, members (the values within one bit of the variant) and the aggregates ``more``.
    """
    variants = values.select("*", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))).alias("flip"))
    bit = F.expr("if(flip < 0, 0L, shiftleft(1L, flip))")
    met = (
        variants.withColumns({"variant": F.col("fp").bitwiseXOR(bit), "mask": bit})
        .groupBy(*keys, "variant")
        .agg(
            F.bit_or("mask").alias("flips"),
            F.max(F.col("mask") == 0).alias("itself"),
            *[column.alias(name) for name, column in more.items()],
        )
        .filter((F.bit_count("flips") + F.col("itself").cast("int")) > 1)
    )
    flipped = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit("flips", i) == 1)
    near = F.transform(
        flipped,
        lambda i: F.col("variant").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    members = F.when(F.col("itself"), F.concat(near, F.array("variant"))).otherwise(near)
    return met.select(*keys, "variant", members.alias("members"), *more)


def close_pairs(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct`` (column fp) within two bits.

    Members of one group are within two bits of each other, so a star around the smallest one
    links them all; every pair within two bits shares a group.
    """
    return (
        balls(distinct)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .filter("a <> b")
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        .distinct()
    )


def grouped(distinct: DataFrame) -> DataFrame:
    """``distinct`` (a stored table with distinct fingerprints in column fp) and ``root``, the smallest
    fingerprint that links reach."""
    # Dealt before variants are made, so that tasks follow the variants and not the stored files.
    tasks = max(1, math.ceil(distinct.count() * (BITS + 1) / VARIANTS_A_TASK))
    roots = connected_components(close_pairs(distinct.select("fp").repartition(tasks, "fp")))
    found = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return stored(found.withColumn("root", F.coalesce("root", "fp")), "roots")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Fingerprints link within two bits. component_id is the smallest doc_id that links reach; it is
    null only if no document of the component has an id. Texts without words, null ones included,
    have fingerprint zero and link like others. Repeated rows stay and share a component. Equal
    fingerprints are merged before variants are made, so copies cost nothing there.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    found = grouped(stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct"))
    smallest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    components = found.join(smallest, "root").select("fp", "component_id")
    return rows.join(components, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of ``near_duplicates`` the one with the smallest id.

    A row without an id only stays if no row of the component has one. Of rows that share that id
    the smallest checksum of id and text decides, and of rows that share both one stays. Texts
    without words, null ones included, are copies of each other. All columns of ``docs`` are kept
    as they are.
    """
    key = row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("row_key")
    rows = stored(fingerprints(docs.select("doc_id", key, "text"), shingle, ("doc_id", "row_key")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key")).alias("first")
    found = grouped(stored(rows.groupBy("fp").agg(first), "distinct"))
    stays = found.groupBy("root").agg(F.min("first").alias("first")).select("first.row_key")
    gone = stored(rows.select("row_key").distinct().join(stays, "row_key", "left_anti"), "gone")
    return without_rows(docs, rows, gone)
