"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents is expected
``target / source words`` times. Inside the source the expected copies are prefix-summed in a fixed
order, one random offset is added, and a document is emitted once per integer that its stretch of
the sum crosses. So a source's copies never differ from their expected number by one or more,
and no document exceeds its expected copies rounded up.

The order goes by size class, large ones first, so that what rounding adds or leaves out over the
whole source is at most about one large document. Inside a class it is random (MD5 of the id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, positions, stored, unit_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SLICES = 256


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


# Eight classes per power of two, in the order of the sizes; 0 for size 0.
SIZE_CLASS = "if(size <= 0, 0, length(bin(size)) * 16 + shiftright(size * 16, length(bin(size))))"


def source_targets(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
) -> DataFrame:
    """One row per source: its documents, words and target.

    ``sized`` has columns source and size. Sources by code point, null last, take ``weights`` in
    turn. They share ``share`` times all words; a target stops at ``most`` times the source's words
    and the excess goes to the others by weight, until none is above. That is the level at which
    ``min(most * words, weight * level)`` adds up; sources fill in the order of words per weight,
    so one running sum finds it.
    """
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")
    )
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = (
        totals.withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn(
            "_open",
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        )
        .withColumn("_full", F.col("_ratio") * F.col("_open") <= F.col("_left"))
        # Level after the last full source; the first open row has it.
        .withColumn(
            "_level",
            F.min(F.when(~F.col("_full"), F.struct("_ratio", F.col("_left") / F.col("_open"))))
            .over(everything)["col2"],
        )
    )
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * F.col("_level"))
    return capped.select("source", "source_size", "source_rows", "weight", target.alias("target"))


def _sampled(sized: DataFrame, options: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """Copies of each row of ``sized`` (doc_id, source, size and ``carry``)."""
    seed, slices = options.pop("seed", 0), options.pop("slices", SLICES)
    targets = source_targets(sized, **options)
    # A null source joins like any other.
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    rows = sized.withColumns(
        {
            "_source": key,
            "_class": F.expr(SIZE_CLASS).cast("int"),
            "_spread": unit_hash(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"))),
        }
    )
    classes = (
        rows.groupBy("_source", "_class")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_ahead",
            F.coalesce(
                F.sum("_rows").over(
                    Window.partitionBy("_source")
                    .orderBy(F.desc("_class"))
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_rows")
    )
    # One row per source and class with all that its documents need.
    plan = classes.join(
        targets.select(
            key.alias("_source"),
            "source_size",
            "target",
            F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)).alias("_rate"),
            unit_hash(F.concat_ws(":", F.lit(f"offset {seed}"), F.col("source"))).alias("_offset"),
        ),
        "_source",
    )
    ranked = positions(
        rows, ["_source", "_class"], "_spread", ["doc_id", "size"], slices, "_place"
    ).join(plan, ["_source", "_class"])
    place = F.col("_ahead") + F.col("_place")
    after = F.floor(F.col("_rate") * (place + 1) + F.col("_offset"))
    copies = after - F.floor(F.col("_rate") * place + F.col("_offset"))
    return ranked.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        *carry,
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """Columns doc_id, source, size, source_size, target, copies and taken for every row of ``docs``.

    Options: ``weights``, ``share``, ``most`` (see :func:`source_targets`), ``seed`` and ``slices``
    (tasks per size class of a source; no influence on the result). The same input gives the same
    mix. Documents without words have size 0 and take no words, whatever their copies; a source
    without words is left out. A null source is a source of its own. Repeated rows are sampled one
    by one. Other columns of ``docs`` are not read.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return _sampled(stored(sized, "sizes"), options)


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), whole)
    mixed = _sampled(stored(sized, "mix"), options, carry=("row",))
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mixed.filter("copies > 0").select("row", F.explode(copies)).select("row.*")
