import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


SCRATCH = tempfile.mkdtemp(prefix="bindery-tests-")

# Made here, not in the fixture: tests build column expressions while they are
# imported, and those need a session.
SESSION = (
    SparkSession.builder.master("local[8]")
    .appName("bindery-tests")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.driver.memory", "8g")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.sql.maxMetadataStringLength", "2000")  # plans are read in tests
    .config("spark.sql.warehouse.dir", f"{SCRATCH}/warehouse")
    .config("spark.checkpoint.dir", f"{SCRATCH}/checkpoint")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def make_files(spark):
    """`files` rows from (bundle, path, bytes) in the given order."""
    from pyspark.sql import functions as F

    from bindery.sources.tables import files_from_table

    def make(rows):
        table = spark.createDataFrame(
            [(i, b, p, bytearray(c)) for i, (b, p, c) in enumerate(rows)],
            "seq long, bundle string, path string, content binary",
        )
        return files_from_table(
            table, F.col("path"), F.col("content"), F.col("seq"), F.col("bundle")
        )

    return make


@pytest.fixture
def evaluate(spark):
    """Values of a column expression over one input column `x`."""

    def run(column, values, kind="string"):
        if kind == "binary":
            values = [None if v is None else bytearray(v) for v in values]
        rows = list(enumerate(values))
        df = spark.createDataFrame(rows, f"i int, x {kind}").repartition(4)
        return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]

    return run
