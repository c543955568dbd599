"""Helpers that several operators share: scratch tables, sessions, Arrow output."""

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources import storage

# What ``[^\x20\x09-\x0D]+`` in SQL and ``WHITE`` in bytes call a word break.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = "[^\\x20\\x09-\\x0D]+"


#: Bytes of texts or results that pass to or from a Python worker at once; the session's default is 64 MB.
BATCH_BYTES = 8 << 20
#: Rows of a file that a task decodes at once, and bytes of a table that it holds before it writes them.
SCAN_ROWS, ROW_GROUP_BYTES = 256, 8 << 20


#: Spark's own switch: the files of a query's shuffles go when it has ended, not when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run in here leaves no shuffle files; for results that are read from a table from then on."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


class Scratch:
    """Tables in the shared folder of the cluster that cut lineage for one run.

    Every table is written once, read back by Spark and survives lost executors.
    ``drop`` removes the ones that no later result reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = storage.shared_dir(spark)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def save(self, df: DataFrame, name: str, row_group: int = ROW_GROUP_BYTES) -> DataFrame:
        # A writer holds a row group until it is full.
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").option("parquet.block.size", str(row_group)).parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            storage.delete(self.spark, self.path(name))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers of this session import the package from where the driver has it.

    A cluster that installs the package, or gets it by ``--py-files``, does not need this.
    """
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, home]))


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session: the package in its workers, and batches of bounded bytes.

    Texts differ in length by orders of magnitude, so a number of rows bounds nothing.  Spark's
    reader knows no other bound, and the arrays it decodes into keep the size of their largest
    batch, for texts and for rows of long arrays: a batch of it has few rows.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text, with NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def batches_of(columns: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about BATCH_BYTES at most from columns of equal length, none if they are empty."""
    arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
    if n := len(arrays[0]):
        whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
        step = max(1, n * BATCH_BYTES // max(BATCH_BYTES, whole.nbytes))
        for first in range(0, n, step):
            yield whole.slice(first, step)
