"""The registered queries: operators applied to whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus_queries
from checks import fixtures as fx
from pagemill.functions import html as H
from pagemill.functions import text as X
from pagemill.operators import catalog as C
from pagemill.operators import chat, extract, reconcile, resume
from pagemill.plans import harvest
from pagemill.schemas import CATALOG, CATALOG_COLUMNS, LISTING_PAGES, METADATA
from pagemill.sources import chunks, landing, snapshots, storage
from pagemill.sources.catalog_store import CatalogStore
from pagemill.streaming import ingest

PRUNED_CATEGORY = 3


def extract_listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_listing_rows(fx.listing_pages(spark, sf_dir))


def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.malformed_rows(fx.listing_pages(spark, sf_dir))


def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_states(fx.listing_pages(spark, sf_dir))


def numeric_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.regexp_extract("url", "^[^?#]*/([^/?#]+)", 1)
    rows = fx.table(spark, sf_dir, "pages").select("page_id", segment.alias("segment"))
    return extract.numeric_guard(rows, "segment")


def parse_pub_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.catalog(spark, sf_dir)
    return rows.select("link", "pub_date", X.pub_date(F.col("pub_date")).alias("pub_day"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events")
    return rows.select("event_id", X.json_field(F.col("props"), "k").alias("k"))


def normalize_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(X.normalize_space(F.col("text"))).alias("digest"))


def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", X.blank_to_null(X.strip(F.col("text"))).alias("stripped"))


def run_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", X.run_stamp(F.col("ts")).alias("stamp"))


def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = H.next_page(F.col("current_page"), F.col("last_page"))
    return fx.progress(spark, sf_dir).select("seq", "current_page", "last_page", following.alias("next_page"))


def category_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.crawled(spark, sf_dir)
    return rows.select("id", X.category_url(F.col("id")).alias("url"))


# --- chunks, catalog, snapshots ---


def _written_chunks(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    root = storage.shared_dir(spark)
    rows = fx.catalog(spark, sf_dir).withColumn("last_page", F.lit(None).cast("int"))
    chunks.write_chunks(rows, root, "1")
    return root, rows


def write_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load is written, then the same load again; pages count once."""
    root, rows = _written_chunks(spark, sf_dir)
    chunks.write_chunks(rows, root, "1")
    return chunks.page_summary(chunks.scan_chunks(spark, root)).select("id", "page", "n")


def scan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _written_chunks(spark, sf_dir)
    return chunks.catalog_rows(chunks.scan_chunks(spark, root))


def prune_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _written_chunks(spark, sf_dir)
    chunks.delete_chunks(spark, root, PRUNED_CATEGORY)
    return chunks.catalog_rows(chunks.scan_chunks(spark, root))


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = fx.catalog(spark, sf_dir)
    return rows.where("batch = 0"), rows.where("batch = 1")


def merge_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consolidate(*_old_and_new(spark, sf_dir), "merge")


def overwrite_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consolidate(*_old_and_new(spark, sf_dir), "overwrite")


def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_members(C.scan_union(*_old_and_new(spark, sf_dir)))


def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.catalog(spark, sf_dir)
    return C.merge_report(rows, C.keep_last(rows))


def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored unique base takes in stored new rows."""
    root, (old, new) = storage.shared_dir(spark), _old_and_new(spark, sf_dir)
    base = snapshots.staged(C.keep_last(old), f"{root}/base", "1")
    return C.upsert_keep_last(base, snapshots.staged(new, f"{root}/new", "1"))


def write_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both formats of the catalog, read back; links have blanks at both ends."""
    store = CatalogStore(spark, storage.shared_dir(spark))
    rows = C.keep_last(fx.catalog(spark, sf_dir)).withColumn("link", F.concat(F.lit("\t "), "link", F.lit("  ")))
    store.write(rows, "1", unique=True)
    parquet = store.read().select(*CATALOG_COLUMNS, F.lit("parquet").alias("format"))
    schema = CATALOG[: len(CATALOG_COLUMNS)]
    csv = snapshots.read_latest(spark, store.csv, schema, "csv")
    return parquet.unionByName(csv.withColumn("format", F.lit("csv")))


def duplicates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report a merge leaves behind, one directory per run."""
    store = CatalogStore(spark, storage.shared_dir(spark))
    old, new = _old_and_new(spark, sf_dir)
    store.merge(old, "1", csv=False)
    store.merge(new, "2", csv=False)
    return snapshots.read_latest(spark, store.duplicates, CATALOG)


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata is written twice; the newer run is what readers get."""
    root, metadata = storage.shared_dir(spark), fx.crawled(spark, sf_dir)
    snapshots.write_run(metadata.withColumn("size", F.lit(0).cast("bigint")), root, snapshots.new_run(), "csv")
    snapshots.write_run(metadata, root, snapshots.new_run(), "csv")
    return snapshots.read_latest(spark, root, METADATA, "csv")


# --- reconciliation ---


def rows_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.rows_per_page(fx.catalog(spark, sf_dir))


def rows_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.rows_per_category(reconcile.rows_per_page(fx.catalog(spark, sf_dir)))


def volume_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of uneven length, so that the estimate is not the true count."""
    return reconcile.volume_estimate(fx.found_counts(spark, sf_dir))


def crawl_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.crawl_metadata(reconcile.category_domain(spark), fx.listing_pages(spark, sf_dir))


def empty_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.empty_categories(crawl_metadata(spark, sf_dir))


def crawled_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.crawled(fx.crawled(spark, sf_dir), 2)


def eligible_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.eligible_categories(reconcile.category_domain(spark), fx.crawled(spark, sf_dir))


def completeness_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.completeness_by_category(fx.catalog(spark, sf_dir), fx.crawled(spark, sf_dir))


def completeness_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.completeness_global(fx.catalog(spark, sf_dir), fx.crawled(spark, sf_dir))


# --- resume ---


def progress_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.page_counts(spark, sf_dir)
    pages = pages.join(pages.groupBy("id").agg(F.max("page").alias("last_page")), "id")
    return resume.progress_entries(pages, "20240101000000")


def last_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.last_progress(fx.progress(spark, sf_dir), ["seq"])


def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.resume_plan(fx.crawled(spark, sf_dir), last_progress(spark, sf_dir))


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = fx.found_counts(spark, sf_dir).where("n > 0")
    return resume.missing_pages(fx.crawled(spark, sf_dir), saved)


def stalled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of category 5 have lost their category."""
    log = fx.progress(spark, sf_dir)
    return resume.stalled_pages(log.withColumn("category_id", F.nullif("category_id", F.lit(5))))


def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the domain, the same under ids beyond it, and one under no id."""
    pages = fx.found_counts(spark, sf_dir)
    beyond = pages.withColumn("id", F.when(F.col("id") != 2, F.col("id") + 100))
    return resume.contiguous_prefix(pages.unionByName(beyond))


# --- whole jobs ---


def _landed(spark: SparkSession, sf_dir: str) -> tuple[str, harvest.Workspace]:
    root = storage.shared_dir(spark)
    landing.write_pages(fx.listing_pages(spark, sf_dir).repartition("id", "page"), f"{root}/landing")
    return f"{root}/landing", harvest.Workspace(f"{root}/space")


def harvest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two harvests: the second finds everything done and changes nothing."""
    pages, space = _landed(spark, sf_dir)
    harvest.run(spark, pages, space.root)
    harvest.run(spark, pages, space.root, skip_crawl=True)
    return CatalogStore(spark, space.root).read()


def harvest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A harvest landed in two steps, merged, and compared with its metadata."""
    pages, space = _landed(spark, sf_dir)
    harvest.crawl(spark, pages, space)
    for batch in (0, 1):
        harvest.store_pages(landing.read_pages(spark, pages).where(F.col("batch") == batch), space, str(batch))
        harvest.consolidate_chunks(spark, space, csv=False)
    return harvest.check_by_category(spark, space)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old pages arrive by stream and make the catalog, new ones are upserted.

    Each landing is taken in about two micro-batches, however large it is.
    """
    root = storage.shared_dir(spark)
    space = harvest.Workspace(f"{root}/space")
    pages = snapshots.staged(fx.listing_pages(spark, sf_dir), f"{root}/pages", "1")
    for batch in (0, 1):
        landing.write_pages(pages.where(F.col("batch") == batch), f"{root}/landing")
        files = len(spark.read.schema(LISTING_PAGES).parquet(f"{root}/landing").inputFiles())
        ingest.stream_upsert(spark, f"{root}/landing", space, max(1, files // (2 * (batch + 1))))
    return CatalogStore(spark, space.root).read()


def check_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of one category at a time; 12 is empty."""
    pages, space = _landed(spark, sf_dir)
    harvest.run(spark, pages, space.root)
    checked = [harvest.check(spark, space, c).select(F.lit(c).alias("id"), "*") for c in (1, 2, 12)]
    return C.scan_union(*checked)


def harvest_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A harvest of the old pages, then a forced one of all: the catalog is replaced."""
    root = storage.shared_dir(spark)
    space, pages = harvest.Workspace(f"{root}/space"), fx.listing_pages(spark, sf_dir)
    landing.write_pages(pages.where("batch = 0"), f"{root}/landing")
    harvest.run(spark, f"{root}/landing", space.root)
    landing.write_pages(pages.where("batch = 1"), f"{root}/landing")
    harvest.run(spark, f"{root}/landing", space.root, force=True)
    return CatalogStore(spark, space.root).read()


def harvest_crawl_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, space = _landed(spark, sf_dir)
    harvest.run(spark, pages, space.root, crawl_only=True)
    return harvest.read_crawled(spark, space)


def consolidate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job dies after the second run is written, before its load is dropped; the next call changes nothing."""
    pages, space = _landed(spark, sf_dir)
    for batch in (0, 1):
        landed = landing.read_pages(spark, pages).where(F.col("batch") == batch)
        harvest.store_pages(landed, space, str(batch))
        run = harvest.consolidate_chunks(spark, space, csv=False)
    harvest.store_pages(landed, space, "1")  # as it was
    storage.touch(spark, f"{snapshots.run_path(space.merged, run)}/load=1/_MERGED")
    harvest.consolidate_chunks(spark, space, csv=False)
    return CatalogStore(spark, space.root).read()


def relanded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page lands again, as two copies, with other drugs; category 3 has no batch numbers.

    Both ways into the chunk store, which have to agree.
    """
    root = storage.shared_dir(spark)
    batch = F.when(F.col("id") != 3, F.col("batch"))
    pages = snapshots.staged(fx.listing_pages(spark, sf_dir).withColumn("batch", batch), f"{root}/pages", "1")
    later = pages.where("page % 2 = 0").withColumn("html", F.replace("html", F.lit("<b>Drug"), F.lit("<b>Redrug")))
    landing.write_pages(pages, f"{root}/landing")
    landing.write_pages(later.unionByName(later), f"{root}/landing")
    rows = []
    for way in ("batch", "stream"):
        space = harvest.Workspace(f"{root}/{way}")
        if way == "batch":
            harvest.store_pages(landing.read_pages(spark, f"{root}/landing"), space, "1")
        else:
            ingest.ingest_pages(spark, f"{root}/landing", space)
        stored = chunks.scan_chunks(spark, space.chunks)
        rows.append(chunks.catalog_rows(chunks.saved_rows(stored)).withColumn("way", F.lit(way)))
    return C.scan_union(*rows)


def assemble_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and twenty at a time as one, which are longer than any alone."""
    turns = fx.table(spark, sf_dir, "conversations")
    twenty = F.floor(F.col("conv_id") / 20)
    joined = turns.withColumn("turn", (F.col("conv_id") - twenty * 20) * 1000 + F.col("turn"))
    return chat.assemble_chat(turns.unionByName(joined.withColumn("conv_id", -1 - twenty)))


def harvest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: pages to rows, rows merged, the result set against metadata."""
    pages = fx.listing_pages(spark, sf_dir)
    rows = extract.extract_listing_rows(pages)
    merged = C.keep_last(rows)
    metadata = reconcile.crawl_metadata(reconcile.category_domain(spark), pages)
    return reconcile.completeness_by_category(merged, metadata)


QUERIES = {
    f.__name__: f
    for f in (
        extract_listing_rows,
        malformed_rows,
        page_states,
        numeric_guard,
        parse_pub_date,
        json_field,
        normalize_space,
        strip_text,
        run_stamp,
        next_page,
        category_url,
        write_chunks,
        scan_chunks,
        prune_category,
        merge_keep_last,
        overwrite_catalog,
        duplicate_members,
        merge_report,
        upsert_keep_last,
        write_catalog,
        duplicates_report,
        latest_snapshot,
        rows_per_page,
        rows_per_category,
        volume_estimate,
        crawl_metadata,
        empty_categories,
        crawled_filter,
        eligible_categories,
        completeness_by_category,
        completeness_global,
        progress_entries,
        last_progress,
        resume_plan,
        missing_pages,
        stalled_pages,
        contiguous_prefix,
        harvest_run,
        harvest_check,
        harvest_force,
        harvest_crawl_only,
        check_category,
        consolidate_replay,
        relanded_pages,
        stream_upsert,
        assemble_chat,
        harvest_report,
    )
} | corpus_queries.QUERIES
