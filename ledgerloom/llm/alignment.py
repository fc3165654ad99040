"""Alignment of two tokenizers' tokens over the bytes of each text, by galloping intersection.

Both tokenizers cut the same bytes, so each gives an ascending list of the offsets where its tokens
end. Every end of the shorter list is searched in the longer one: steps that double from the last
place on, then a binary search between the last two. The place found is the end's rank there.
Ends in both lists cut the tokens into groups, and the ranks of a token's begin and end give the
range of tokens of the other list that overlap it. No pair that does not overlap is looked at.

How often an id pair is linked is counted over the whole corpus. Documents look their pairs up as
token counts do: pairs that make up one link in ``FREQUENT`` or more, at most so many, are known to
every task, and all others, none of which can be hot, are joined by shuffling.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, stored
from .vocabularies import default_path, in_runs, read_vocabulary, vocabulary

FREQUENT = 1 << 18
# Characters of text whose pre-tokens are aligned together.
RUN = 1 << 20


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each value of ``short`` how many of ``long`` are smaller; both ascend."""
    at, count = 0, len(long)
    ranks = []
    for value in short:
        low = high = at
        step = 1
        while high < count and long[high] < value:
            low = high + 1
            high += step
            step += step
        at = bisect_left(long, value, low, min(high, count))
        ranks.append(at)
    return ranks


class Aligned(NamedTuple):
    """Two lists of tokens over the same bytes: ends of the groups in either, and all overlapping pairs."""

    a_cuts: np.ndarray
    b_cuts: np.ndarray
    a_links: np.ndarray
    b_links: np.ndarray


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> Aligned:
    """Groups and overlaps of two tilings of the same bytes, from the ascending ends of their tokens.

    ``a_cuts`` and ``b_cuts`` hold, per group, the number of tokens up to its end.
    """
    if len(a_ends) > len(b_ends):
        a_cuts, b_cuts, a_links, b_links = align(b_ends, a_ends)
        return Aligned(b_cuts, a_cuts, b_links, a_links)
    if not len(a_ends):
        none = np.zeros(0, dtype=np.int64)
        return Aligned(none, none, none, none)
    last = np.array(gallop(a_ends.tolist(), b_ends.tolist()), dtype=np.int64)
    common = b_ends[last] == a_ends
    # A token overlaps from where the one before it ends, or from the next on if that is a common end.
    first = np.concatenate(([0], last[:-1] + common[:-1]))
    overlaps = last - first + 1
    return Aligned(
        np.flatnonzero(common) + 1,
        last[common] + 1,
        np.repeat(np.arange(len(a_ends)), overlaps),
        _ranges(first, overlaps),
    )


class Names:
    """Ids as decimal text, with what follows them in a list of groups."""

    def __init__(self, size: int, inside: str, end: str):
        self.inside = np.array([f"{i}{inside}" for i in range(size)], dtype=object)
        self.end = np.array([f"{i}{end}" for i in range(size)], dtype=object)

    def text(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        found = self.inside[ids]
        found[cuts - 1] = self.end[ids[cuts - 1]]
        return found


def group_names(a: np.ndarray, b: np.ndarray, found: Aligned, a_names: Names, b_names: Names) -> np.ndarray:
    """The ids of each group in order, those of A first, as text with separators."""
    a_sizes, b_sizes = np.diff(found.a_cuts, prepend=0), np.diff(found.b_cuts, prepend=0)
    merged = np.empty(len(a) + len(b), dtype=object)
    merged[np.arange(len(a)) + np.repeat(found.b_cuts - b_sizes, a_sizes)] = a_names.text(a, found.a_cuts)
    merged[np.arange(len(b)) + np.repeat(found.a_cuts, b_sizes)] = b_names.text(b, found.b_cuts)
    return merged


class Encoder:
    """One of the two vocabularies with what is needed of its ids."""

    def __init__(self, file: tuple[str, bytes], end: str):
        self._vocabulary = vocabulary(*file)
        self.split, self._bytes = self._vocabulary.split, self._vocabulary.token_bytes()
        self._sizes = np.array([len(token) for token in self._bytes])
        self.names = Names(len(self._bytes), ",", end)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in one array, and where each part's begin (and the last one's end)."""
        found = self._vocabulary.encode(parts)
        at = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)), out=at[1:])
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=at[-1]), at

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self._sizes[ids])

    def lengths(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bytes of each part."""
        return np.diff(np.concatenate(([0], self.ends(ids)))[at])

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join([self._bytes[i] for i in ids.tolist()])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of ranges that begin at ``starts``, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Parts:
    """Distinct pre-tokens, aligned in one go as if they were one text."""

    def __init__(self, parts: list[str], a: Encoder, b: Encoder):
        (a_ids, a_at), (b_ids, b_at) = a.encode(parts), b.encode(parts)
        self.whole = self._unchanged(parts, a, b, a_ids, a_at, b_ids, b_at)
        # Parts that either vocabulary changes have no tokens here.
        self.n_a, self.n_b = np.diff(a_at) * self.whole, np.diff(b_at) * self.whole
        a_ids, b_ids = a_ids[np.repeat(self.whole, np.diff(a_at))], b_ids[np.repeat(self.whole, np.diff(b_at))]
        a_at, b_at = np.cumsum(self.n_a), np.cumsum(self.n_b)
        found = align(a.ends(a_ids), b.ends(b_ids))
        self.n_groups = np.diff(np.searchsorted(found.a_cuts, a_at, side="right"), prepend=0)
        self.pairs = (a_ids[found.a_links] << 32) | b_ids[found.b_links]
        links = np.searchsorted(found.a_links, a_at)
        self.n_links = np.diff(links, prepend=0)
        self._link = links - self.n_links
        names, at = group_names(a_ids, b_ids, found, a.names, b.names).tolist(), (a_at + b_at).tolist()
        self._groups = ["".join(names[i:j]) for i, j in zip([0, *at[:-1]], at, strict=True)]

    @staticmethod
    def _unchanged(parts, a, b, a_ids, a_at, b_ids, b_at) -> np.ndarray:
        """Whether the joined bytes of A and of B are those of the part. All at once, if all are."""
        raw = [part.encode() for part in parts]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        if (a.lengths(a_ids, a_at) == sizes).all() and (b.lengths(b_ids, b_at) == sizes).all():
            if a.joined(a_ids) == b.joined(b_ids) == b"".join(raw):
                return np.ones(len(parts), dtype=bool)
        bounds = zip(raw, a_at[:-1], a_at[1:], b_at[:-1], b_at[1:], strict=True)
        return np.array([a.joined(a_ids[i:j]) == part == b.joined(b_ids[k:m]) for part, i, j, k, m in bounds], dtype=bool)

    def text(self, at: np.ndarray) -> tuple:
        """The columns of a text that consists of the parts at these places."""
        pairs = self.pairs[_ranges(self._link[at], self.n_links[at])]
        pairs, times = np.unique(pairs, return_counts=True)
        sums = (int(each[at].sum()) for each in (self.n_a, self.n_b, self.n_groups, self.n_links))
        return *sums, "".join([self._groups[i] for i in at.tolist()])[:-1], pairs, times


def aligned_texts(texts: list[str], a: Encoder, b: Encoder) -> list[tuple]:
    """``n_a, n_b, n_groups, n_links, groups, pairs, times`` of each text.

    A space that follows no white space begins a pre-token in either vocabulary, so tokens of both
    end before it. Pre-tokens between such places are aligned once, however often they occur.
    """
    place: dict[str, int] = {}
    cut = [np.array([place.setdefault(part, len(place)) for part in a.split(text)], dtype=np.int64) for text in texts]
    parts = Parts(list(place), a, b)
    rows = []
    for text, at in zip(texts, cut, strict=True):
        if parts.whole[at].all():
            rows.append(parts.text(at))
            continue
        one = Parts([text], a, b)  # decided on the whole text, as joined bytes are
        rows.append(one.text(np.zeros(int(one.whole[0]), dtype=np.int64)))
    return rows


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``(row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times)`` of every row of ``docs``.

    A encodes a space and the text, B the text, before which it puts a space itself; special tokens
    are neither added nor recognised. ``groups`` lists the ids of each group (``a1,a2|b1;a3|b2``),
    ``pairs`` the distinct linked pairs as ``a << 32 | b`` with the links of each in ``times``.
    Texts that are null or empty, or that the joined bytes of A or B do not give back, have no
    tokens. Texts are read whole, in runs of about ``RUN`` characters; a longer one is a run by itself.
    """
    context = docs.sparkSession.sparkContext
    a_path = a_path or default_path("byte_bpe_50k.json")
    b_path = b_path or default_path("piece_bpe_32k.model")
    files = context.broadcast((read_vocabulary(a_path), read_vocabulary(b_path)))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (Encoder(file, end) for file, end in zip(files.value, "|;", strict=True))
        for batch in portions(batches, 512):
            at = 0
            # The text with its space: none of an empty one.
            texts = (" " + t if t else "" for t in batch.column("text").to_pylist())
            for run in in_runs(texts, RUN):
                n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*aligned_texts(run, a, b), strict=True)
                own = batch.slice(at, len(run))
                at += len(run)
                yield pa.RecordBatch.from_arrays(
                    [own.column("row"), own.column("doc_id"),
                     *(pa.array(numbers, pa.int64()) for numbers in (n_a, n_b, n_groups, n_links)),
                     pa.array(groups, pa.large_string()).cast(pa.string()),
                     pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )

    text = F.coalesce("text", F.lit("")).alias("text")
    wanted = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text)
    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(
        compute,
        f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups string, pairs array<bigint>, times array<bigint>",
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links of each id pair in the corpus, and whether no pair with its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("one"))
    counts = each.groupBy(F.col("one.pairs").alias("pair")).agg(F.sum("one.times").alias("n"))
    counts = stored(counts, "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # one row per B id at most
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``(row, n_best, count_sum)`` of the rows of ``aligned``, a stored table: its links by their pairs' counts."""
    spark = aligned.sparkSession
    counts = stored(pair_counts(aligned), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    table = counts.filter(F.col("n") * frequent >= total).toArrow().sort_by("pair")
    common = spark.sparkContext.broadcast(tuple(
        table[name].to_numpy().astype(kind) for name, kind in (("pair", np.int64), ("n", np.int64), ("best", bool))
    ))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = common.value
        for batch in portions(batches, 256):
            bests, sums, rest, more = [], [], [], []
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                pairs = pairs.values.to_numpy(zero_copy_only=False)
                times = times.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(known, pairs).clip(max=max(len(known) - 1, 0))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
                at, links = at[hit], times[hit]
                bests.append(int(links[best[at]].sum()))
                sums.append(int((links * n[at]).sum()))
                rest.append(pairs[~hit])
                more.append(times[~hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rest, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))],
                names=["row", "n_best", "count_sum", "rest", "more"],
            )

    found = aligned.select("row", "pairs", "times").mapInArrow(
        compute, "row bigint, n_best bigint, count_sum bigint, rest array<bigint>, more array<bigint>"
    )
    found = stored(found, "known-links")
    others = (
        found.select("row", F.explode(F.arrays_zip("rest", "more")).alias("one"))
        .select("row", F.col("one.rest").alias("pair"), F.col("one.more").alias("links"))
        .join(counts, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("n")).alias("count_sum"),
        )
    )
    both = found.select("row", "n_best", "count_sum").unionByName(others)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT
) -> DataFrame:
    """Columns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``n_best`` counts the links whose pair is the most linked one of its B id in the corpus, ties
    included; ``count_sum`` adds up the corpus counts over all links. Rows without tokens have zeros
    and an empty ``groups_sha256``. Repeated rows and ids all stay, and their links all count. Other
    columns of ``docs`` are not read. ``frequent`` moves work between lookup and join and never
    changes a result. ``alignments`` gives the groups themselves.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = alignments(docs, a_path, b_path).withColumn("groups_sha256", digest).drop("groups")
    found = stored(found, "alignments")
    plain = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return (
        found.select(*plain)
        .join(link_counts(found, frequent), "row")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    )
