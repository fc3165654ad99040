"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# What the tables of the training corpus look like, for empty folders and tests.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@cache
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a temporary one with a local master; a cluster has to name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later plans start from the files, so a lost executor costs a reread, not the lineage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables written by ``stored`` that no later plan reads.

    Shuffles that nothing refers to any more go as well: Spark's cleaner removes their files from
    the executors once the driver has collected its garbage, which iterations must not wait for.
    """
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


# Rows of a side that may be sent to every task; sides of this package have about 100 bytes a row.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it counts ``rows`` rows at most; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


# Rows that a task takes of a shuffle that needs few tasks.
ROWS_A_TASK = 4_096


def compact(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, dealt by ``keys`` over the few tasks that about ``rows`` rows need.

    Iterations come to small tables, for which hundreds of tasks cost more than their rows. Tables
    that fill the usual number of tasks are left to Spark, which can split a hot key there; here one
    task gets ``ROWS_A_TASK`` rows for each of the usual tasks at most.
    """
    tasks = max(1, math.ceil(rows / ROWS_A_TASK))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks < usual else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is.

    Text of ASCII letters alone takes the fast built-in; both branches agree there.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def row_key(docs_id: Column, text: Column) -> Column:
    """Identifies rows with the same id and text."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(docs_id.cast("string"), F.lit("-")), text))


def without_rows(docs: DataFrame, keys: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` lists; of rows that share id and text one stays.

    ``keys`` has the ``row_key`` of every row, ``gone`` distinct ones; both are stored tables.
    """
    twice = stored(keys.groupBy("row_key").count().filter("count > 1").select("row_key"), "twice")
    keyed = docs.withColumn("_row_key", row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    left = keyed.join(small(gone), keyed["_row_key"] == gone["row_key"], "left_anti")
    if twice.isEmpty():
        return left.drop("_row_key")
    again = left.join(small(twice), left["_row_key"] == twice["row_key"], "left_semi")
    once = left.join(small(twice), left["_row_key"] == twice["row_key"], "left_anti")
    return once.unionByName(again.dropDuplicates(["_row_key"])).drop("_row_key")


def unit_hash(key: Column) -> Column:
    """A stable pseudo-random number in [0, 1) from the MD5 of ``key``; null counts as empty."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def portions(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in portions of ``rows`` rows, which bound what a task's Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def positions(
    df: DataFrame, group: list[str], spread: str, order: list[str], slices: int, into: str
) -> DataFrame:
    """Add the 0-based position ``into`` of each row in its group, by (``spread``, ``order``).

    ``spread`` holds numbers in [0, 1). A group is cut into ``slices`` equal ranges of it, so no
    task sorts a whole group: positions are the rank inside a slice plus the size of the slices
    before it. ``slices`` moves work between tasks and never changes a position.
    """
    if not df.columns:
        return df
    cut = df.withColumn("_slice", F.floor(F.col(spread) * slices).cast("int"))
    keys = [*group, "_slice"]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys).orderBy(spread, *order)
    return (
        cut.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, keys)
        .withColumn(into, F.col("_before") + F.col("_rank"))
        .drop("_slice", "_rank", "_before")
    )
