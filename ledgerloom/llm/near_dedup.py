"""Near-duplicate documents by the similarity of their shingles: one document of each group stays.

Documents are near-duplicates if the sets of their five-word shingles have a Jaccard similarity of
0.8 or more. A fingerprint of ``BANDS * LEVELS[-1]`` minima, each of them the smallest shingle in
another order, agrees between two documents in a share of places that is near their similarity.
Documents of which the first four minima of a band agree meet; at a similarity of 0.8, that happens
in one band at least for all but 2 in 10,000 pairs, whatever was edited and where.

Groups are not paired out. Documents that meet are compared with one leader, the same wherever they
meet; what verified links join is one component. Where components still meet, another leader
follows, and then all rows outside the largest component are compared with the others if they are few.
If they are many, which takes a crowd of documents that share much but not 80%, more minima of the
band have to agree, so that the crowd falls apart and its closest members stay together; in the
last, longest bands all components are compared. Pairs thus grow with the rows and not with their
square. Candidates of which the fingerprints are near enough are verified on the whole texts' shingles,
so no documents are joined that are not similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, discard, portions, row_key, small, stored, without_rows
from .components import connected_components
from .simhash import word_pieces

SHINGLE = 5
SIMILARITY = 0.8
# Fingerprint: bands, and how many minima of a band have to agree at each level.
BANDS = 16
LEVELS = (4, 7, 10, 16)
# Shingles whose orders are worked out at once; bounds memory for long texts.
BLOCK = 512
# Leaders at each level, and how many rows outside the largest component are compared with all that they meet.
ROUNDS = 1
FEW_PAIRS = 32
# Pairs go on if their agreement is at most so many standard deviations below the similarity.
DEVIATIONS = 4


def shingle_set(text: bytes, shingle: int, width: int = 1) -> np.ndarray:
    """The distinct runs of ``shingle`` words, hashed to ``width`` 64-bit numbers each.

    All words make one run if there are fewer; no words give none.
    """
    digest = xxhash.xxh3_64_digest if width == 1 else xxhash.xxh3_128_digest
    seeds = range(1) if width <= 2 else range(width // 2)
    found: set[bytes] = set()
    fewer: list[bytes] = []
    for words in word_pieces(text, shingle):
        if len(words) < shingle:
            fewer = words
            continue
        found.update(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    if not found and fewer:
        found.add(b" ".join(fewer))
    if not found:
        return np.zeros((0, width), dtype=np.uint64)
    parts = [b"".join(map(partial(digest, seed=seed), found)) for seed in seeds]
    each = [np.frombuffer(p, dtype=np.uint64).reshape(len(found), -1) for p in parts]
    return np.concatenate(each, axis=1)


def _orders(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed factors and summands that put 64-bit hashes into ``count`` orders."""
    digest = xxhash.xxh3_64_intdigest
    factors = np.array([digest(f"factor {i}") | 1 for i in range(count)], dtype=np.uint64)
    return factors, np.array([digest(f"summand {i}") for i in range(count)], dtype=np.uint64)


def minima(shingles: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest of the ``shingles`` (64-bit hashes) in each of the orders; those of none are the largest number."""
    factors, summands = orders
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), BLOCK):
        block = shingles[at : at + BLOCK, None] * factors + summands
        np.minimum(least, block.min(axis=0), out=least)
    return least


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, content, size, keys, bytes)``; content is equal for texts of equal words.

    ``keys`` has the hash of the first ``LEVELS[0]`` minima of each band, ``bytes`` the last byte of all minima.
    """
    text = F.coalesce("text", F.lit(""))
    wanted = docs.select("doc_id", row_key(F.col("doc_id"), text).alias("row_key"), text.cast("binary"))
    wide = LEVELS[-1]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(BANDS * wide)
        for batch in portions(batches):
            contents, sizes, keys, last = [], [], [], []
            for value in batch.column(2):
                raw = value.as_py()
                state = xxhash.xxh3_128()
                for words in word_pieces(raw, 1):
                    state.update(b" ".join([*words, b""]))
                contents.append(state.hexdigest())
                shingles = np.unique(shingle_set(raw, SHINGLE))
                sizes.append(len(shingles))
                least = minima(shingles, orders).reshape(BANDS, wide)
                firsts = (row[: LEVELS[0]].tobytes() for row in least)
                keys.append([xxhash.xxh3_64_intdigest(first, seed=i) - (1 << 63) for i, first in enumerate(firsts)])
                last.append(least.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(contents, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(last, pa.binary())],
                names=["doc_id", "row_key", "content", "size", "keys", "bytes"],
            )

    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(
        compute, f"doc_id {kind}, row_key string, content string, size bigint, keys array<bigint>, bytes binary"
    )


def meetings(contents: DataFrame) -> DataFrame:
    """``(key, node, size, band)`` where two contents or more have a key; ``band`` has the last bytes of its minima."""
    wide = LEVELS[-1]
    placed = contents.filter("size > 0").select("node", "size", "bytes", F.posexplode("keys").alias("at", "key"))
    band = F.expr(f"substring(bytes, at * {wide} + 1, {wide})").alias("band")
    placed = placed.select("key", "node", "size", band)
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return stored(placed.join(stored(shared, "shared-keys"), "key"), "meetings")


def _level(rows: DataFrame, level: int, roots: DataFrame | None) -> DataFrame:
    """``(key, node, size, root)`` of meetings in which ``LEVELS[level]`` minima agree."""
    key = F.col("key") if level == 0 else F.xxhash64("key", F.expr(f"substring(band, 1, {LEVELS[level]})"))
    rows = rows.select(key.alias("key"), "node", "size")
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(rows: DataFrame, count: int) -> DataFrame:
    """``(key, top, others)``: where several components meet, the largest one and the rows outside it."""
    each = compact(rows, count, "key").groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", "root")).alias("top")
    mixed = each.groupBy("key").agg(top, F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    return mixed.select("key", F.col("top.root").alias("top"), (F.col("n") - F.col("top.n")).alias("others"))


def _pairs(left: DataFrame, right: DataFrame, similarity: float, count: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that meet and whose sizes allow them to be similar.

    ``count``: rows of the larger side.
    """
    x, y = F.col("x.node"), F.col("y.node")
    a, b = F.col("x.size"), F.col("y.size")
    fits = F.least(a, b) >= F.greatest(a, b) * similarity - 1e-6
    pairs = (
        left.alias("x")
        .join(right.alias("y"), F.col("x.key") == F.col("y.key"))
        .filter((F.col("x.root") != F.col("y.root")) & fits)
        .select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    )
    return compact(pairs, 4 * count, "a", "b").distinct()


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, root)`` with new ``links`` between nodes: only components that they join are worked out anew."""
    count = links.count()
    if roots is None:
        return connected_components(links, count)
    ends = compact(links.select(F.col("a").alias("node")).union(links.select("b")), 2 * count, "node").distinct()
    fresh = ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    known = stored(roots.unionByName(fresh), "known")
    left = known.select(F.col("node").alias("a"), F.col("root").alias("x"))
    right = known.select(F.col("node").alias("b"), F.col("root").alias("y"))
    between = links.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = connected_components(between, count).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return known.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def linked(
    met: DataFrame, contents: DataFrame, docs: DataFrame, similarity: float = SIMILARITY,
    few_pairs: int = FEW_PAIRS, rounds: int = ROUNDS,
) -> DataFrame:
    """``(node, root)`` of all nodes that links join. ``met`` as from ``meetings``; ``contents``: node,
    row_key, bytes. ``few_pairs`` and ``rounds`` decide where pairs are compared and how many are.
    """
    tested = roots = None
    place = ("key", "node", "size", "root")
    for level in range(len(LEVELS)):
        last = level == len(LEVELS) - 1
        size = met.count()
        for turn in range(rounds + 1):
            mixed = stored(_mixed(_level(met, level, roots), size), "mixed")
            if mixed.isEmpty():
                break
            rows = stored(_level(met, level, roots).join(mixed, "key"), "mixed-rows")
            count = rows.count()
            others = rows.filter("root <> top")
            if turn < rounds:
                # The first leaders are the same in all bands; later ones differ, outside the largest component.
                order = F.xxhash64("node") if roots is None else F.xxhash64("node", "key", F.lit(turn))
                head = F.min(F.struct(order.alias("order"), "node", "size", "root")).alias("head")
                heads = compact(rows if roots is None else others, count, "key").groupBy("key").agg(head)
                heads = stored(heads.select("key", "head.*"), "heads")
                pairs = _pairs(rows.select(*place), heads, similarity, count)
            else:
                few = others if last else others.filter(F.col("others") <= few_pairs)
                pairs = _pairs(few.select(*place), rows.select(*place), similarity, count)
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stored(pairs, "candidates")
            likely = stored(promising(pairs, contents, similarity), "promising")
            sets = shingles_of(likely, contents, docs)
            more = stored(verified(likely, sets, similarity), "verified")
            discard(rows, likely, sets)
            tested = pairs if tested is None else tested.unionByName(pairs)
            if not more.isEmpty():
                roots = stored(_joined(roots, more), "roots")
        if mixed.isEmpty() or last:
            break
        crowds = _mixed(_level(met, level, roots), size).filter(F.col("others") > few_pairs)
        crowds = crowds.select(F.col("key").alias("crowd"))
        key = F.col("key") if level == 0 else F.xxhash64("key", F.expr(f"substring(band, 1, {LEVELS[level]})"))
        crowds = stored(crowds, "crowds")
        met = stored(met.join(crowds, key == F.col("crowd"), "left_semi"), "crowded")
    if roots is None:
        return met.select("node", F.col("node").alias("root")).limit(0)
    return roots


def promising(pairs: DataFrame, contents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose fingerprints agree about as often as those of similar documents do."""
    left = contents.select(F.col("node").alias("a"), F.col("bytes").alias("left"))
    right = contents.select(F.col("node").alias("b"), F.col("bytes").alias("right"))
    places = BANDS * LEVELS[-1]
    least = places * (similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / places))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, places) for i in (2, 3)
            )
            yield batch.select([0, 1]).filter(pa.array((one == other).sum(axis=1) >= least))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(compute, "a bigint, b bigint")


def shingles_of(pairs: DataFrame, contents: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, shingles)`` of all nodes in ``pairs``; the text of a node is that of its row key."""
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = stored(contents.join(paired, "node").select("node", "row_key"), "asked")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(row_key(F.col("doc_id"), text).alias("row_key"), text.cast("binary").alias("text"))
    chosen = keyed.join(small(asked), "row_key").select("node", "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of repeated rows, a task gives one
        for batch in portions(batches, 64):
            nodes, sets = [], []
            for node, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node not in done:
                    done.add(node)
                    nodes.append(node)
                    sets.append(np.unique(shingle_set(value.as_py(), SHINGLE).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    found = stored(chosen.mapInArrow(compute, "node bigint, shingles array<bigint>"), "shingles")
    discard(asked)
    if found.groupBy("node").count().filter("count > 1").isEmpty():
        return found
    return stored(found.dropDuplicates(["node"]), "shingles")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose five-word shingle sets are similar enough. ``sets``: node, shingles."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    either = F.size("left") + F.size("right") - both
    return (
        pairs.join(left, "a").join(right, "b").filter(both >= similarity * either).select("a", "b")
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the smallest id.

    Texts of the same words, case of A-Z aside, are near-duplicates; so are all texts without
    words, null ones included. A row without an id only stays if no row of the group has one. Of
    rows that share id and text one stays. All columns of ``docs`` are kept as they are.
    """
    rows = stored(sketches(docs), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key"))
    sketched = F.any_value(F.struct("size", "keys", "bytes")).alias("sketch")
    contents = rows.groupBy("content").agg(one.alias("first"), sketched)
    contents = stored(
        contents.select(F.monotonically_increasing_id().alias("node"), "content", "first", "sketch.*"), "contents"
    )
    keyed = contents.select("node", F.col("first.row_key").alias("row_key"), "bytes")
    roots = linked(meetings(contents), keyed, docs)
    grouped = stored(contents.select("node", "content", "first").join(roots, "node"), "grouped")
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"))
    followers = grouped.join(stays, "root").select("content", "stays")
    # Rows to drop: those of a content or group that another row stands for, and further copies.
    judged = (
        rows.select("content", "row_key")
        .join(contents.select("content", "first"), "content")
        .join(stored(followers, "linked"), "content", "left")
        .select("row_key", F.coalesce("stays.row_key", "first.row_key").alias("stays"))
    )
    gone = stored(judged.filter("row_key <> stays").select("row_key").distinct(), "gone")
    return without_rows(docs, rows, gone)
