"""The tables of a two-ledger warehouse as one bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ledgerloom import constants as C
from ledgerloom.functions.periods import Span, within
from ledgerloom.sources.schemas import TABLES, checked
from ledgerloom.sources.state import DayKeys, DayManifest, FirstSeen


class Ledger:
    """Named access to the source tables, opened on first use.

    Parameters
    ----------
    opener
        Maps a table name to its DataFrame.
    genesis
        First day of the ``all_time`` period.
    shared_block_time
        Set it when an event always carries the block time of its transaction.
        Range filters then apply to both sides of a transaction-event join, so
        neither side is read outside the range. Results do not change when the
        statement is true, which the caller vouches for.
    first_seen, manifest, day_keys
        Tables kept beside the facts (see :mod:`~.state`), which must hold the
        same days as these. Metrics that look back read them instead of history;
        weekly and monthly distinct counts read ``manifest`` and ``day_keys``.
    """

    def __init__(
        self,
        opener: Callable[[str], DataFrame],
        *,
        genesis: date = C.GENESIS,
        shared_block_time: bool = False,
        first_seen: FirstSeen | None = None,
        manifest: DayManifest | None = None,
        day_keys: DayKeys | None = None,
    ):
        self._opener = opener
        self._open: dict[str, DataFrame] = {}
        self.genesis = genesis
        self.shared_block_time = shared_block_time
        self.first_seen = first_seen
        self.manifest = manifest
        self.day_keys = day_keys

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame], **options) -> "Ledger":
        return cls(frames.__getitem__, **options)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, **options) -> "Ledger":
        """Tables stored as ``<root>/<table>``.

        The files' own schema says whether ``event_data`` is still raw and
        whether all columns are there (see :func:`~.schemas.checked`).
        """
        return cls(lambda name: checked(spark.read.parquet(f"{root}/{name}"), name), **options)

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, names: Mapping[str, str], **options
    ) -> "Ledger":
        """Catalog tables, by table name; raw ``event_data`` is unpacked."""
        return cls(lambda name: checked(spark.table(names[name]), name), **options)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._opener(name)
        return self._open[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self[name]
        raise AttributeError(name)

    def partner(self, name: str, span: Span) -> DataFrame:
        """The other side of a join whose range is set on its partner table."""
        df = self[name]
        if self.shared_block_time and "block_timestamp" in df.columns:
            return within(df, span)
        return df
