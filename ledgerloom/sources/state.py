"""Small tables kept beside the facts, a day at a time, so that daily reports need not reread history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.periods import Span, within


def _replace_days(df: DataFrame, path: str) -> None:
    """Write the days of ``df``, a row set with ``block_date``, and leave all other days alone.

    A day is replaced as a whole, so adding it again, or later, changes nothing else.
    """
    (
        df.repartition("block_date", F.pmod(F.xxhash64(*df.columns), F.lit(4)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("block_date")
        .parquet(path)
    )


def whole_days(days: DataFrame, span: Span) -> DataFrame:
    """The rows of ``days`` whose ``block_date`` is inside ``span``; the files of other days are not read."""
    if span.start is not None:
        days = days.filter(F.col("block_date") >= F.lit(span.start))
    if span.end is not None:
        days = days.filter(F.col("block_date") < F.lit(span.end))
    return days


# What metrics look up: accounts and native contracts by their rows, EVM deployments by their day.
ACCOUNT_KINDS = {"native": "native_account", "evm": "evm_account"}
CONTRACT_KIND = "native_contract"
DEPLOYMENT_KIND = "evm_deployment"
KEYS = {
    "native_account": "account string",
    "evm_account": "account string",
    CONTRACT_KIND: "event_contract string",
    DEPLOYMENT_KIND: "contract string, creator string",
}


class FirstSeen:
    """When each key first shows up, by kind of key.

    A kind is a table ``<path>/<kind>`` with one row per key and day: the first time of the day.
    Its fold is a minimum, which does not depend on the order in which days were added. Each
    :meth:`add` takes whole days and replaces them, so a late day, or a day with late rows, is
    added once more; nothing else is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Mapping[str, str] = KEYS):
        self._spark = spark
        self._path = path
        self._keys = keys

    def add(self, kind: str, rows: DataFrame, when: str = "block_timestamp") -> None:
        """Add all ``rows`` of some days; those without a time are left out, NULL keys are kept."""
        keys = [column.split()[0] for column in self._keys[kind].split(", ")]
        day = F.to_date(when).alias("block_date")
        firsts = rows.filter(F.col(when).isNotNull()).groupBy(day, *keys).agg(F.min(when).alias("first"))
        _replace_days(firsts, f"{self._path}/{kind}")

    def seen(self, kind: str, span: Span = Span()) -> DataFrame:
        """The keys of ``kind`` inside ``span`` and their ``first`` time there.

        Only the days of the span are read. The bounds of a span are midnights, so whole days are
        what a scan of the facts would find.
        """
        schema = f"{self._keys[kind]}, first timestamp, block_date date"
        days = self._spark.read.schema(schema).parquet(f"{self._path}/{kind}")
        days = whole_days(days, span)
        keys = [c for c in days.columns if c not in ("first", "block_date")]
        return days.groupBy(*keys).agg(F.min("first").alias("first"))


class DayManifest:
    """How many rows of each kind a day has: one row per day and kind.

    Like :class:`FirstSeen` it takes whole days and replaces them; a day without rows is not in it.
    Rows without a time make a day of their own, NULL, which no range of days contains.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path

    def add(self, kind: str, rows: DataFrame) -> None:
        day = F.to_date("block_timestamp").alias("block_date")
        counts = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
        _replace_days(counts, f"{self._path}/{kind}")

    def days(self, kind: str) -> DataFrame:
        """``(block_date, n)`` of every day that has rows of ``kind``."""
        return self._spark.read.schema("n bigint, block_date date").parquet(f"{self._path}/{kind}")

    def latest(self, kinds: Sequence[str], before: date) -> DataFrame:
        """``latest``: the last day before ``before`` on which one of ``kinds`` has rows, as a timestamp."""
        days = [self.days(kind).filter(F.col("block_date") < F.lit(before)) for kind in kinds]
        every = days[0]
        for more in days[1:]:
            every = every.union(more)
        return every.filter("n > 0").agg(F.max("block_date").cast("timestamp").alias("latest"))


class KeyNumbers:
    """A number for each key of a kind, given once and kept: nearly dense and from 1 on.

    Keys are dealt to ``slices`` by a hash; the keys of a slice are numbered one after the other and
    the numbers of all slices interleaved, so no task ever sees all keys. A kind is an append-only
    table ``<path>/<slices>/<kind>``; it has one writer at a time. Giving numbers to known keys again
    changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, slices: int = 256):
        self._spark = spark
        self._path = f"{path}/{slices}"
        self._slices = slices

    def table(self, kind: str) -> DataFrame:
        """``(key, number)`` of all known keys."""
        path = f"{self._path}/{kind}"
        schema = "key string, number bigint"
        self._spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return self._spark.read.schema(schema).parquet(path)

    def give(self, kind: str, keys: DataFrame) -> None:
        """Number the new ones among ``keys``, a column ``key``; NULL gets no number."""
        known = self.table(kind)
        slot = F.pmod(F.xxhash64("key"), F.lit(self._slices)).alias("slot")
        new = keys.filter("key IS NOT NULL").distinct().join(known, "key", "left_anti").select("key", slot)
        used = known.groupBy(slot).agg(F.count(F.lit(1)).alias("used"))
        place = F.row_number().over(Window.partitionBy("slot").orderBy("key")) - 1
        number = (F.coalesce("used", F.lit(0)) + F.col("place")) * self._slices + F.col("slot") + 1
        (
            new.withColumn("place", place)
            .join(used, "slot", "left")
            .select("key", number.cast("bigint").alias("number"))
            .write.mode("append")
            .parquet(f"{self._path}/{kind}")
        )


class DayKeys:
    """Which keys the rows of each day have, so that longer distinct counts are unions of days.

    A table ``<path>/days/<kind>.<key>`` has a row per day and run of 32,768 key numbers
    (:class:`KeyNumbers`), with a bitmap of the numbers that occur. A week's or month's exact distinct
    count is the number of bits in the union of its days; facts are not read, and what is shuffled are
    bitmaps. Days are replaced as a whole, like those of :class:`FirstSeen`. A day whose rows have
    NULL keys has a row with an empty bitmap, so it is there with a count of 0.
    """

    def __init__(self, spark: SparkSession, path: str, slices: int = 256):
        self._spark = spark
        self._path = f"{path}/days"
        self._numbers = KeyNumbers(spark, f"{path}/numbers", slices)

    def add(self, kind: str, key: str, rows: DataFrame) -> None:
        """Add all ``rows`` of some days, by their column ``key``."""
        name = f"{kind}.{key}"
        pairs = rows.select(F.to_date("block_timestamp").alias("block_date"), F.col(key).alias("key")).distinct()
        self._numbers.give(name, pairs.select("key"))
        bitmaps = (
            pairs.join(self._numbers.table(name), "key", "left")
            .groupBy("block_date", F.bitmap_bucket_number("number").alias("run"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("keys"))
        )
        _replace_days(bitmaps, f"{self._path}/{name}")

    def days(self, kind: str, key: str) -> DataFrame:
        """``(run, keys, block_date)`` of every day that has rows."""
        schema = "run bigint, keys binary, block_date date"
        return self._spark.read.schema(schema).parquet(f"{self._path}/{kind}.{key}")


def count_keys(days: DataFrame, by: Column, bucket: str, into: str) -> DataFrame:
    """``(bucket, into)``: distinct keys of rows of :meth:`DayKeys.days` per value of ``by``."""
    return (
        days.groupBy(by.alias(bucket), "run")
        .agg(F.bitmap_count(F.bitmap_or_agg("keys")).alias("n"))
        .groupBy(bucket)
        .agg(F.sum("n").alias(into))
    )


def add_first_seen(state: FirstSeen, ledger, deployments, span: Span = Span()) -> None:
    """Add the days of ``span`` (default: all) of ``ledger`` to ``state``.

    ``deployments(ledger, span)`` gives rows (bucket, creator, contract) by the day, see
    ``operators.deployments.evm_deployments``.
    """
    actors = within(ledger.native_actor, span).select("block_timestamp", F.explode("actors").alias("account"))
    state.add(ACCOUNT_KINDS["native"], actors)
    senders = within(ledger.evm_tx, span).select("block_timestamp", F.col("from_address").alias("account"))
    state.add(ACCOUNT_KINDS["evm"], senders)
    state.add(CONTRACT_KIND, within(ledger.native_event, span))
    by_day = Span(span.start, span.end, "day")
    state.add(DEPLOYMENT_KIND, deployments(ledger, by_day), when="bucket")
