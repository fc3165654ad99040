"""Exact dedup: a two-pass Bloom filter keeps rows that cannot repeat out of the shuffle.

Pass 1 counts, per bit of a filter of fixed size, whether it was set once or more often. Every
task emits its bits in segments, which are merged by segment. Pass 2 asks for each row whether all
of its bits were set more than once. If not, its text is unique and the row passes straight
through; only the others shuffle, to be grouped by their exact hash.

A filter has ``filter_bytes`` bytes at most: the driver's and the broadcast's bound. With more rows
than it holds well (``BITS_PER_ROW`` bits each), the hash range is cut into rounds with a filter
each. False positives only shuffle in vain; false negatives do not exist.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WHITE = b" \t\n\x0b\x0c\r"
PROBES = 4
BITS_PER_ROW = 16
SEGMENT_BITS = 1 << 19
FILTER_BYTES = 64 << 20


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_points, digest)``: SHA-256 of each text without white space, as 32 bytes."""
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_points"),
        F.coalesce(text_col, F.lit("")).cast("binary").alias("_bytes"),
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                hashlib.sha256(raw.as_py().translate(None, WHITE)).digest()
                for raw in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())],
                names=["doc_id", "n_points", "digest"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(digest, f"doc_id {kind}, n_points bigint, digest binary")


def _words(column: pa.Array) -> np.ndarray:
    """The digests as rows of four unsigned 64-bit words."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype="<u8").reshape(len(column), 4)


def _probes(words: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` bit positions a row, by double hashing of two words of the digest."""
    step = words[:, 2] | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack(
            [(words[:, 1] + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)], axis=1
        ).astype(np.int64)


def _repeated_bits(digests: DataFrame, low: int, high: int, bits: int) -> np.ndarray:
    """Filter of the bits that the digests with a first word in [low, high) set more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, dtype=np.uint8)
        for batch in batches:
            words = _words(batch.column(0))
            words = words[(words[:, 0] >= low) & (words[:, 0] <= high)]
            # One bit twice for one digest is no repeat; only other rows may raise it again.
            flat = np.sort(_probes(words, bits), axis=1)
            fresh = np.ones(flat.shape, dtype=bool)
            fresh[:, 1:] = flat[:, 1:] != flat[:, :-1]
            position, times = np.unique(flat[fresh], return_counts=True)
            seen[position] = np.minimum(2, seen[position] + np.minimum(times, 2)).astype(np.uint8)
        for at in range(0, bits, SEGMENT_BITS):
            part = seen[at : at + SEGMENT_BITS]
            if part.any():
                once, twice = np.packbits(part >= 1).tobytes(), np.packbits(part >= 2).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"segment": pa.array([at // SEGMENT_BITS], pa.int32()), "once": [once], "twice": [twice]}
                )

    def merge(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        once = twice = None
        at = 0
        for batch in batches:
            for segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if once is None:
                    once, twice, at = a.copy(), b.copy(), segment
                else:
                    twice |= b | (once & a)
                    once |= a
        yield pa.RecordBatch.from_pydict(
            {"segment": pa.array([at], pa.int32()), "twice": [twice.tobytes()]}
        )

    segments = (
        digests.select("digest")
        .mapInArrow(count, "segment int, once binary, twice binary")
        .groupBy("segment")
        .applyInArrow(merge, "segment int, twice binary")
    )
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for row in segments.toLocalIterator():  # filter_bytes in all
        part = np.frombuffer(row.twice, np.uint8)
        start = row.segment * (SEGMENT_BITS // 8)
        packed[start : start + len(part)] = part
    return packed


def possibly_repeated(digests: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Add ``repeated``: False only where no other row has the digest."""
    spark = digests.sparkSession
    rows = digests.count()
    most = filter_bytes * 8
    rounds = max(1, -(-rows * BITS_PER_ROW // most))
    want = max(SEGMENT_BITS, -(-rows * BITS_PER_ROW // rounds))
    bits = -(-want // SEGMENT_BITS) * SEGMENT_BITS
    edges = [(1 << 64) * i // rounds for i in range(rounds + 1)]
    out = None
    for low, after in zip(edges, edges[1:], strict=False):
        high = after - 1
        filled = spark.sparkContext.broadcast(_repeated_bits(digests, low, high, bits))

        def ask(batches, filled=filled, low=low, high=high):
            packed = filled.value
            for batch in batches:
                words = _words(batch.column("digest"))
                mine = (words[:, 0] >= low) & (words[:, 0] <= high)
                table = pa.Table.from_batches([batch]).filter(pa.array(mine))
                probes = _probes(words[mine], bits)
                hits = (packed[probes >> 3] >> (7 - (probes & 7)).astype(np.uint8)) & 1
                table = table.append_column("repeated", pa.array(hits.all(axis=1)))
                yield from table.to_batches()

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digests.schema)
        part = digests.mapInArrow(ask, f"{schema}, repeated boolean")
        out = part if out is None else out.unionByName(part)
    return out


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: which row of its equal texts stays.

    Texts are equal when identical after deleting white space. Of equal texts the longest original
    stays (code points), then the smallest id; a null id comes last. Of rows that share id and text,
    one stays. Null texts count as empty and form one group.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Other columns of ``docs`` are not read.
    """
    # The row number is fixed by being stored: it tells rows apart that share an id.
    numbered = text_digests(docs, id_col, text_col).withColumn(
        "row", F.monotonically_increasing_id()
    )
    digests = stored(numbered, "digests")
    flagged = stored(possibly_repeated(digests, filter_bytes), "flagged")
    single = flagged.filter(~F.col("repeated")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    rest = flagged.filter("repeated")
    best = F.min_by(
        F.struct("doc_id", "row"),
        F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "row"),
    )
    # Stored, so that the join starts from two shuffles and a hot digest can be split there.
    groups = stored(
        rest.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")),
        "groups",
    )
    grouped = rest.join(groups, "digest").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return single.unionByName(grouped)
