"""Token counts: pieces are counted once per distinct pre-token and summed over each document's pre-tokens.

No ids are kept anywhere. A first pass collects the distinct pre-tokens of all texts with the number
of their uses, and each is encoded once. A second pass takes every document's pre-token frequencies.
The most used pre-tokens, with all that make up one use in ``FREQUENT`` or more, are known to every
task; there are no more than ``2 * FREQUENT``, whatever the corpus. All others are joined by
shuffling, and none of those can be hot, since each has a smaller share of all uses.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, stored
from .vocabularies import default_path, read_vocabulary, vocabulary

LIMIT = 4096
FREQUENT = 1 << 18
# Longer pre-tokens are never sent to all tasks, so the dictionary is bounded in bytes as well.
LONGEST = 128
# Distinct pre-tokens that a task counts before it passes them on.
HELD = 200_000


def pre_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``(token, uses, pieces)``: the distinct pre-tokens of all texts, stored."""
    model = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabulary(*model.value).split
        uses: Counter[str] = Counter()

        def found() -> pa.RecordBatch:
            arrays = [pa.array(uses.keys(), pa.string()), pa.array(uses.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["token", "uses"])

        for batch in portions(batches, 64):
            for value in batch.column(0):
                uses.update(split(value.as_py()))
                if len(uses) > HELD:
                    yield found()
                    uses.clear()
        yield found()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(*model.value).encode
        for batch in portions(batches, 4096):
            pieces = [len(ids) for ids in encoder(batch.column(0).to_pylist())]
            arrays = [*batch.columns, pa.array(pieces, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "uses", "pieces"])

    texts = docs.select("text").filter("text <> ''")
    uses = texts.mapInArrow(count, "token string, uses bigint").groupBy("token").agg(F.sum("uses").alias("uses"))
    return stored(uses.mapInArrow(encode, "token string, uses bigint, pieces bigint"), "pre-tokens")


def frequent_tokens(tokens: DataFrame, frequent: int = FREQUENT) -> dict[str, int]:
    """Pieces of the most used short pre-tokens, of ``2 * frequent`` at most.

    Those are all with at least one use in ``frequent`` of all, of which there can be no more than
    that, and all from the lowest power of two of uses on that leaves no more than ``frequent``.
    """
    short = tokens.filter(F.length("token") <= LONGEST)
    uses = F.floor(F.log2("uses"))
    ranges = short.groupBy(uses.alias("range")).agg(F.count(F.lit(1)).alias("n"), F.sum("uses").alias("uses"))
    least, held = 64, 0
    rows = ranges.orderBy(F.desc("range")).collect()  # 64 rows at most
    for row in rows:
        held += row["n"]
        if held > frequent:
            break
        least = row["range"]
    total = sum(row["uses"] for row in rows)
    chosen = short.filter((F.col("uses") * frequent >= total) | (uses >= least))
    table = chosen.select("token", "pieces").toArrow()
    return dict(zip(table["token"].to_pylist(), table["pieces"].to_pylist(), strict=True))


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT
) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    ``path`` is a public vocabulary (default ``piece_bpe_32k.model``): ``.model`` files count as the
    sentencepiece library encodes, ``.json`` files of byte-level BPE as the tokenizers library does,
    without begin, end or other special tokens; their strings in a text are ordinary text.
    Null and empty texts have no bytes and no tokens. Rows are told apart by themselves, so repeated
    rows, repeated and missing ids all stay. Texts are never cut short: a very long one only passes
    its pre-tokens on in portions. Other columns of ``docs`` are not read, whatever their names.
    ``frequent`` moves work between dictionary and join and never changes a count.
    """
    path = path or default_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_vocabulary(path))
    tokens = pre_tokens(docs, path)
    common = spark.sparkContext.broadcast(frequent_tokens(tokens, frequent))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = vocabulary(*model.value).split, common.value
        for batch in portions(batches, 64):
            sums, rest, times = [], [], []
            for value in batch.column(3):
                total, others = 0, {}
                for token, n in Counter(split(value.as_py())).items():
                    pieces = known.get(token)
                    if pieces is None:
                        others[token] = n
                    else:
                        total += n * pieces
                sums.append(total)
                rest.append(list(others.keys()))
                times.append(list(others.values()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.string())),
                 pa.array(times, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_bytes", "known", "rest", "times"],
            )

    text = F.coalesce("text", F.lit(""))
    wanted = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    kind = wanted.schema["doc_id"].dataType.simpleString()
    counted = wanted.mapInArrow(
        compute,
        f"row bigint, doc_id {kind}, n_bytes bigint, known bigint, rest array<string>, times array<bigint>",
    )
    counted = stored(counted, "pre-token-frequencies")
    each = counted.select("row", F.explode(F.arrays_zip("rest", "times")).alias("one"))
    rest = (
        each.select("row", F.col("one.rest").alias("token"), F.col("one.times").alias("n"))
        .join(tokens.select("token", "pieces"), "token")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    )
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return (
        counted.select("row", "doc_id", "n_bytes", "known")
        .join(rest, "row", "left")
        .select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
    )
