import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Log lines from a dictionary of file rank to texts, in blocks of two lines."""
    from logtrawl import lines_of

    def make(files, block_rows=2):
        rows = [(rank, n, text) for rank, texts in files.items() for n, text in enumerate(texts)]
        table = spark.createDataFrame(rows, "file_rank bigint, lineno bigint, line string").repartition(3)
        return lines_of(table, pos="lineno", block_rows=block_rows, keep=["lineno"])

    return make
