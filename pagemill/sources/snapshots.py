"""Immutable runs of a table: a run is written once and never replaced.

A table is a directory of ``run=<name>`` directories.  Readers take the newest
run that is complete, so a job that dies while writing leaves the table as it
was, and nothing ever overwrites a path that is being read.
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagemill.sources import storage


def new_run() -> str:
    """A run name; names sort by time."""
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")


def run_path(table: str, run: str) -> str:
    return f"{table}/run={run}"


def _runs(spark: SparkSession, table: str) -> list[str]:
    return [n.removeprefix("run=") for n in storage.children(spark, table) if n.startswith("run=")]


def is_complete(spark: SparkSession, table: str, run: str) -> bool:
    return storage.exists(spark, f"{run_path(table, run)}/_SUCCESS")


def complete_runs(spark: SparkSession, table: str) -> list[str]:
    return [n for n in _runs(spark, table) if is_complete(spark, table, n)]


def latest_run(spark: SparkSession, table: str) -> str | None:
    return next((n for n in reversed(_runs(spark, table)) if is_complete(spark, table, n)), None)


# Quotes are doubled, and a field may hold line breaks.  Empty fields are NULL and
# quoted empty fields are empty texts; reading tells them apart only when the
# NULL text is one that no field can be.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# A file with line breaks in fields is read by one task, so files are kept small.
_CSV_WRITE = {**_CSV, "maxRecordsPerFile": 1_000_000}
_CSV_READ = {**_CSV, "multiLine": True, "nullValue": "\uffff"}


def write_run(rows: DataFrame, table: str, run: str, file_format: str = "parquet") -> None:
    options = _CSV_WRITE if file_format == "csv" else {}
    rows.write.format(file_format).options(**options).mode("overwrite").save(run_path(table, run))


def read_run(
    spark: SparkSession, table: str, run: str, schema: T.StructType, file_format: str = "parquet"
) -> DataFrame:
    options = _CSV_READ if file_format == "csv" else {}
    return spark.read.format(file_format).options(**options).schema(schema).load(run_path(table, run))


def read_latest(
    spark: SparkSession, table: str, schema: T.StructType, file_format: str = "parquet"
) -> DataFrame | None:
    """The newest complete run, or None when there is none."""
    run = latest_run(spark, table)
    return None if run is None else read_run(spark, table, run, schema, file_format)


def staged(rows: DataFrame, table: str, run: str) -> DataFrame:
    """The rows, written as a table and read back.

    For an intermediate result that is used more than once, or whose size the
    planner should know.
    """
    write_run(rows, table, run)
    return read_run(rows.sparkSession, table, run, rows.schema)
