"""The consolidated catalog: parquet runs, a CSV twin, and the duplicates report."""

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators.catalog import consolidate, duplicate_members, scan_union, upsert_duplicates
from pagemill.schemas import CATALOG, CATALOG_COLUMNS
from pagemill.sources import snapshots, storage

# Marks a run in which each protocol occurs once.
_UNIQUE = "_UNIQUE"


class CatalogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.parquet = f"{root}/categories"
        self.csv = f"{root}/categories_csv"
        self.csv_due = f"{root}/categories_csv_due"
        self.duplicates = f"{root}/duplicates"

    def read(self) -> DataFrame | None:
        """The newest catalog; None when it is missing or empty."""
        rows = snapshots.read_latest(self.spark, self.parquet, CATALOG)
        return None if rows is None or rows.isEmpty() else rows

    def is_unique(self) -> bool:
        run = snapshots.latest_run(self.spark, self.parquet)
        return run is not None and storage.exists(self.spark, f"{snapshots.run_path(self.parquet, run)}/{_UNIQUE}")

    def write(self, rows: DataFrame, run: str, unique: bool, csv: bool = True) -> None:
        """Write a new run, then its CSV twin from the files just written.

        That a twin is due is noted before the run is complete, and until the twin is.
        """
        if csv:
            storage.touch(self.spark, f"{snapshots.run_path(self.csv_due, run)}/_DUE")
        snapshots.write_run(rows.select(*CATALOG.names), self.parquet, run)
        if unique:
            storage.touch(self.spark, f"{snapshots.run_path(self.parquet, run)}/{_UNIQUE}")
        if csv:
            self.finish_csv()

    def finish_csv(self) -> None:
        """Write the CSV twin of the newest run if it is due: after the run, or after a crash in between."""
        run = snapshots.latest_run(self.spark, self.parquet)
        due = run is not None and storage.exists(self.spark, f"{snapshots.run_path(self.csv_due, run)}/_DUE")
        if due and not snapshots.is_complete(self.spark, self.csv, run):
            written = snapshots.read_run(self.spark, self.parquet, run, CATALOG)
            snapshots.write_run(written.select(*CATALOG_COLUMNS), self.csv, run, "csv")
        storage.delete(self.spark, self.csv_due)

    def merge(self, new: DataFrame, run: str, mode: str = "merge", csv: bool = True, stage: str | None = None) -> None:
        """Consolidate new rows into the next run; an error fails the job.

        A merge uses the new rows more than once, so they are written to
        ``stage`` first.  Their stored size then also tells the planner whether
        the old catalog has to be shuffled to be joined with them.
        """
        old = self.read()
        merging = old is not None and mode == "merge"
        old_is_unique = self.is_unique()
        if merging:
            new = new if stage is None else snapshots.staged(new, stage, run)
            members = upsert_duplicates(old, new) if old_is_unique else duplicate_members(scan_union(old, new))
            snapshots.write_run(members, self.duplicates, run)
        self.write(consolidate(old, new, mode, old_is_unique), run, merging, csv)
