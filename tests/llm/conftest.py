import pytest

from ledgerloom.llm.common import DOCUMENTS


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows."""

    def build(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture
def clashing(docs_of):
    """Adds columns whose names the operators use inside."""

    def widen(df):
        from pyspark.sql import functions as F

        names = ("size", "row", "digest", "text_key", "words", "fp", "content", "label", "_rows", "copies", "a", "b")
        return df.withColumns({n: F.lit("x") for n in names})

    return widen
