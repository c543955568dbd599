"""The harvest: measure, plan, extract, save, consolidate, check."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import reconcile, resume
from pagemill.operators.catalog import stale_versions, without_versions
from pagemill.operators.extract import extract_chunk_rows
from pagemill.schemas import CATALOG, CATEGORY_IDS, METADATA
from pagemill.sources import chunks, landing, progress, snapshots, storage
from pagemill.sources.catalog_store import CatalogStore


@dataclass(frozen=True)
class Workspace:
    """Where the tables of a harvest live, under one shared directory."""

    root: str

    @property
    def crawled(self) -> str:
        return f"{self.root}/crawled"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    @property
    def chunks(self) -> str:
        return f"{self.root}/chunks"

    @property
    def merged(self) -> str:
        """For a catalog run in the making, the loads that go into it."""
        return f"{self.root}/merged"

    @property
    def staged(self) -> str:
        return f"{self.root}/staged"


def crawl(spark: SparkSession, pages_path: str, space: Workspace) -> DataFrame:
    """Write a new run of crawl metadata from the first and last pages.

    Both reads filter on literals, so the parquet scan skips every other page.
    """
    pages = landing.read_pages(spark, pages_path)
    first_pages = landing.pages_at(pages, [(c, 1) for c in CATEGORY_IDS])
    first = reconcile.first_page_stats(first_pages)
    metadata = reconcile.crawl_metadata(reconcile.category_domain(spark), pages, first, landing.newest_pages)
    run = snapshots.new_run()
    snapshots.write_run(metadata.coalesce(1), space.crawled, run, "csv")
    return snapshots.read_run(spark, space.crawled, run, METADATA, "csv")


def read_crawled(spark: SparkSession, space: Workspace, category_id: int | None = None) -> DataFrame | None:
    """The newest crawl metadata; None when there is none for the category."""
    metadata = snapshots.read_latest(spark, space.crawled, METADATA, "csv")
    if metadata is None:
        return None
    rows = reconcile.crawled(metadata, category_id)
    return None if rows.isEmpty() else rows


def plan(spark: SparkSession, space: Workspace, force: bool = False) -> DataFrame:
    """Action and first page of each category that has metadata."""
    metadata = read_crawled(spark, space)
    if metadata is None:
        metadata = spark.createDataFrame([], METADATA)
    eligible = metadata.join(reconcile.category_domain(spark), "id", "left_semi")
    return resume.resume_plan(eligible, progress.read_last(spark, space.progress), force)


def scrape(spark: SparkSession, pages_path: str, space: Workspace, force: bool = False, csv: bool = True) -> str | None:
    """Save the pages still to do, log them, and consolidate; returns the run.

    Under ``force`` earlier chunks and progress are set aside and the catalog
    is replaced instead of merged.
    """
    if force:
        chunks.delete_chunks(spark, space.chunks)
        progress.new_epoch(spark, space.progress, snapshots.new_run())
    # One row per category of the domain: this is the job's control table.
    todo = [r for r in plan(spark, space, force).collect() if r["action"] != "skip"]
    for row in todo:
        if row["action"] in ("fresh", "restart"):
            chunks.delete_chunks(spark, space.chunks, row["id"])
    load = snapshots.new_run()
    if todo:
        save_pages(spark, pages_path, space, [(r["id"], r["start_page"]) for r in todo], load)
    return consolidate_chunks(spark, space, force, csv)


def save_pages(
    spark: SparkSession, pages_path: str, space: Workspace, starts: list[tuple[int, int]], load: str
) -> None:
    """Extract and store the landed pages from each category's start on."""
    wanted = F.lit(False)
    for category_id, start in starts:
        wanted = wanted | ((F.col("id") == category_id) & (F.col("page") >= start))
    store_pages(landing.read_pages(spark, pages_path).where(wanted), space, load)


def store_pages(pages: DataFrame, space: Workspace, load: str) -> None:
    """Extract landed pages into a load of chunks and log it.

    All landings are extracted where they are read; the rows of replaced ones are
    then left out.  Rows are small, so no page text is ever shuffled.
    """
    spark, pages = pages.sparkSession, landing.identified(pages)
    replaced = snapshots.staged(landing.replaced_landings(pages), f"{space.staged}/replaced", load)
    rows = without_versions(extract_chunk_rows(pages), replaced, ["at"])
    chunks.write_chunks(rows, space.chunks, load)
    storage.delete(spark, snapshots.run_path(f"{space.staged}/replaced", load))
    log_load(spark, space, load)


def log_load(spark: SparkSession, space: Workspace, load: str, now: str | None = None) -> None:
    """Log one entry per page of a load, from the stored rows."""
    pages = chunks.page_summary(chunks.scan_chunks(spark, space.chunks, [load]))
    entries = resume.progress_entries(resume.contiguous_prefix(pages), now or snapshots.new_run()[:14])
    progress.write_progress(entries, space.progress, load)


def consolidate_chunks(spark: SparkSession, space: Workspace, force: bool = False, csv: bool = True) -> str | None:
    """Merge the stored loads into the next catalog run, then drop these loads.

    Loads that arrive meanwhile stay for the next call.  Without chunks the
    catalog is left as it is.  The names of the loads are noted before the run is
    written and forgotten after the drop: if a job dies in between, the next one
    finds the loads of the newest run and drops them without merging them again, and
    writes the CSV twin of that run if it is missing.
    """
    store = CatalogStore(spark, space.root)
    store.finish_csv()
    chunks.delete_loads(spark, space.chunks, merged_loads(spark, space))
    names = chunks.loads(spark, space.chunks)
    stored = chunks.scan_chunks(spark, space.chunks, names)
    if stored is None or stored.isEmpty():
        return None
    run_name = snapshots.new_run()
    # A single load holds each page once.
    current = current_chunks(stored, f"{space.staged}/stale", run_name) if len(names) > 1 else stored
    new = chunks.catalog_rows(chunks.saved_rows(current))
    for name in names:
        storage.touch(spark, f"{snapshots.run_path(space.merged, run_name)}/load={name}/_MERGED")
    store.merge(new, run_name, "overwrite" if force else "merge", csv, f"{space.staged}/new")
    chunks.delete_loads(spark, space.chunks, names)
    for stage in ("stale", "new"):
        storage.delete(spark, snapshots.run_path(f"{space.staged}/{stage}", run_name))
    storage.delete(spark, space.merged)
    return run_name


def merged_loads(spark: SparkSession, space: Workspace) -> list[str]:
    """The loads that the newest complete catalog run was made of."""
    run_name = snapshots.latest_run(spark, CatalogStore(spark, space.root).parquet)
    noted = storage.children(spark, snapshots.run_path(space.merged, run_name)) if run_name else []
    return [n.removeprefix("load=") for n in noted]


def current_chunks(stored: DataFrame, stage: str, run_name: str) -> DataFrame:
    """Stored rows without the page versions that a newer one replaced.

    The replaced versions are found from the keys and written first, so that the
    planner knows their size: few are broadcast, many are joined by a shuffle,
    where a key is one version of one page.
    """
    stale = snapshots.staged(stale_versions(stored, chunks.VERSION), stage, run_name)
    return without_versions(stored, stale, chunks.VERSION)


def check(spark: SparkSession, space: Workspace, category_id: int | None = None) -> DataFrame:
    """Expected against found rows, as one row, of one category or of all."""
    catalog, metadata = _catalog_and_metadata(spark, space)
    if category_id is not None:
        catalog = catalog.where(F.col("id") == category_id)
    return reconcile.completeness_global(catalog, reconcile.crawled(metadata, category_id))


def check_by_category(spark: SparkSession, space: Workspace) -> DataFrame:
    return reconcile.completeness_by_category(*_catalog_and_metadata(spark, space))


def _catalog_and_metadata(spark: SparkSession, space: Workspace) -> tuple[DataFrame, DataFrame]:
    catalog, metadata = CatalogStore(spark, space.root).read(), read_crawled(spark, space)
    return (
        spark.createDataFrame([], CATALOG) if catalog is None else catalog,
        spark.createDataFrame([], METADATA) if metadata is None else metadata,
    )


def run(
    spark: SparkSession,
    pages_path: str,
    root: str,
    force: bool = False,
    check_only: bool = False,
    crawl_only: bool = False,
    skip_crawl: bool = False,
) -> DataFrame | None:
    """A whole harvest.  Returns the check when only that is asked for."""
    space = Workspace(root)
    if check_only:
        return check(spark, space)
    if not skip_crawl:
        crawl(spark, pages_path, space)
    if not crawl_only:
        scrape(spark, pages_path, space, force)
    return None
