"""The corpus pipeline: each stage applies one training-data operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontamination, toxicity
from ledgerloom.llm.common import read, stored
from ledgerloom.llm.mixing import mix_rows
from ledgerloom.llm.sharding import shard_documents
from ledgerloom.llm.simhash import without_near_duplicates


# Rows of a batch handed to Python. The usual 10,000 whole texts, some of them very long, add up in every task.
BATCH_ROWS = 512


def _small_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_ROWS`` rows at most, for the session; results don't depend on them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    _small_batches(spark)
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component that links between SimHash fingerprints join."""
    _small_batches(spark)
    return without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]
# Trained scores and SimHash candidates are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
