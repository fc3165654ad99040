"""Benchmark decontamination with a distributed positional inverted index.

1. Count how often each benchmark word occurs in the training texts.
2. Every benchmark window (``span`` consecutive words) is looked up by its rarest word, its anchor.
3. Store the index: one posting per occurrence of an anchor word in a training text, with its
   position and the words around it.
4. Meet windows and postings by word. A posting at position p is the start p - offset of a window
   whose anchor stands at ``offset``; the words around it, shifted by that offset, must be those of
   the window. So the lists of the other words are intersected at the posting itself.

Texts are known by their MD5, since a result only depends on the text: copies count once.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, stored

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII, with A-Z lower-cased; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def tokenised(docs: DataFrame) -> DataFrame:
    """``(text_key, words)`` of the distinct or repeated texts of ``docs``."""
    return docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("words"))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """Distinct ``(item_id, window)``: runs of ``span`` words, or all words of a shorter item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (span - 1), F.lit(1)))
    return items.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, span))).alias("window")
    ).distinct()


def anchored(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """``(window, term, offset)`` for each distinct window: its rarest word in ``texts``.

    Ties go to the first such word. A window with a word that no text has cannot occur and is left
    out.
    """
    places = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "term"))
    vocabulary = stored(places.select("term").distinct(), "terms")
    counts = stored(
        texts.select(F.explode("words").alias("term"))
        .join(small(vocabulary), "term")
        .groupBy("term")
        .count(),
        "term-counts",
    )
    found = places.join(counts, "term", "left").groupBy("window").agg(
        F.min(F.coalesce("count", F.lit(0))).alias("least"),
        F.min_by(F.struct("term", "offset"), F.struct("count", "offset")).alias("anchor"),
    )
    return found.filter("least > 0").select("window", "anchor.term", "anchor.offset")


def postings(texts: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The index: ``(term, text_key, position, first, around)`` for each occurrence of ``terms``.

    ``around`` holds the words from position ``first`` on, up to ``reach`` of them before and after
    the term. Positions count from 0.
    """
    first = F.greatest(F.col("position") - reach, F.lit(0))
    spread = texts.select("text_key", "words", F.posexplode("words").alias("position", "term"))
    return spread.join(small(terms), "term").select(
        "term",
        "text_key",
        "position",
        first.alias("first"),
        F.slice("words", first + 1, F.col("position") - first + 1 + reach).alias("around"),
    )


def phrase_matches(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(text_key, start, window)`` of every occurrence of an anchored window."""
    start = F.col("position") - F.col("offset")
    here = F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.size("window"))
    return (
        index.join(small(anchors), "term")
        .filter((start >= F.col("first")) & (here == F.col("window")))
        .select("text_key", start.alias("start"), "window")
    )


def proximity_matches(texts: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """``(text_key, left, right, left_at, right_at)``: words at most ``distance`` positions apart.

    ``pairs`` has columns left and right. The index is read once, at the occurrences of ``left``.
    """
    index = postings(texts, pairs.select(F.col("left").alias("term")).distinct(), distance)
    met = index.join(pairs, index["term"] == pairs["left"]).select(
        "text_key", "left", "right", "position", "first", F.posexplode("around").alias("step", "near")
    )
    at = F.col("first") + F.col("step")
    return met.filter((F.col("near") == F.col("right")) & (at != F.col("position"))).select(
        "text_key", "left", "right", F.col("position").alias("left_at"), at.alias("right_at")
    )


def text_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """``(text_key, n_hit, n_items, items_sha256)`` of the texts that hold a benchmark window."""
    texts = tokenised(docs)
    windows = stored(benchmark_windows(benchmark, span), "windows")
    anchors = stored(anchored(windows, texts), "anchors")
    index = stored(postings(texts, anchors.select("term").distinct(), span - 1), "postings")
    found = stored(phrase_matches(index, anchors).distinct(), "matches")
    hit = (
        found.select(
            "text_key",
            F.explode(F.sequence(F.col("start"), F.col("start") + F.size("window") - 1)).alias("at"),
        )
        .groupBy("text_key")
        .agg(F.count_distinct("at").alias("n_hit"))
    )
    items = (
        found.select("text_key", "window")
        .distinct()
        .join(windows, "window")
        .select("text_key", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
        .distinct()
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    return hit.join(items, "text_key").select(
        "text_key",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """Which documents hold windows of the benchmark, one row per row of ``docs``.

    Columns: doc_id, n_words, n_hit (words inside an occurrence), n_items (items with an
    occurrence), items_sha256 (SHA-256 of their ids, sorted as text and comma-joined; of the empty
    text if there are none) and contaminated. Null and empty texts have no words. A null item_id
    counts as the empty text. Items without words match nothing; an empty benchmark hits nothing.
    """
    texts = docs.select(
        "doc_id",
        F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    hits = stored(text_hits(docs, benchmark, span), "hits")
    none = F.sha2(F.lit(""), 256)
    return texts.join(hits, "text_key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns."""
    hits = stored(text_hits(docs, benchmark, span).select("text_key"), "hits")
    key = F.md5(F.coalesce("text", F.lit("")))
    return docs.join(small(hits), key == hits["text_key"], "left_anti")
