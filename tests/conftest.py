import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom import Ledger, configure  # noqa: E402
from ledgerloom.sources import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("ledgerloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def ledger_of(spark):
    """Builds a ledger from lists of dicts; missing tables are empty."""

    def build(genesis=date(2020, 1, 1), **tables):
        def opener(name):
            schema = TABLES[name]
            rows = [tuple(r.get(f.name) for f in schema) for r in tables.get(name, [])]
            return spark.createDataFrame(rows, schema)

        return Ledger(opener, genesis=genesis)

    return build
