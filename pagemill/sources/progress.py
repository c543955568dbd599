"""Progress log: append-only, one entry per saved page.

A forced harvest begins a new epoch; entries of earlier epochs are kept but not
read any more.  Beside the entries of a load, its last entry of each category is
kept: a plan reads these, a row per category and load, and not the log.
"""

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators.resume import last_progress
from pagemill.schemas import PROGRESS
from pagemill.sources import storage


def _epochs(spark: SparkSession, root: str) -> list[str]:
    return [n for n in storage.children(spark, root) if n.startswith("epoch=")]


def new_epoch(spark: SparkSession, root: str, name: str) -> None:
    storage.touch(spark, f"{root}/epoch={name}/_EPOCH")


def write_progress(entries: DataFrame, root: str, load: str) -> None:
    """Log the entries of one load; logging the same load again replaces them."""
    spark = entries.sparkSession
    if not _epochs(spark, root):
        new_epoch(spark, root, "0")
    epoch = _epochs(spark, root)[-1]
    storage.delete(spark, f"{root}/last/{epoch}/load={load}")  # of a former writing
    entries.select(*PROGRESS.names).write.mode("overwrite").parquet(f"{root}/{epoch}/load={load}")
    written = spark.read.schema(PROGRESS).parquet(f"{root}/{epoch}/load={load}")
    last_progress(written).select(*PROGRESS.names).write.mode("overwrite").parquet(f"{root}/last/{epoch}/load={load}")


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(PROGRESS).parquet(*paths) if paths else spark.createDataFrame([], PROGRESS)


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the current epoch; empty when there are none."""
    epochs = _epochs(spark, root)
    folder = f"{root}/{epochs[-1]}" if epochs else root
    return _read(spark, [f"{folder}/{n}" for n in storage.parents_of(spark, folder, "_SUCCESS")] if epochs else [])


def read_last(spark: SparkSession, root: str) -> DataFrame:
    """The last entry of each category in the current epoch.

    A load that was logged, but died before its last entries were kept, is read whole.
    """
    epochs = _epochs(spark, root)
    if not epochs:
        return last_progress(_read(spark, []))
    log, kept = f"{root}/{epochs[-1]}", f"{root}/last/{epochs[-1]}"
    done = set(storage.parents_of(spark, kept, "_SUCCESS"))
    loads = storage.parents_of(spark, log, "_SUCCESS")
    return last_progress(_read(spark, [f"{kept if n in done else log}/{n}" for n in loads]))
