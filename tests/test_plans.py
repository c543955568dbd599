import pytest

from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "RDDScan")
JOBS = {
    "harvest_run", "harvest_check", "harvest_force", "harvest_crawl_only", "check_category", "consolidate_replay", "relanded_pages",
    "stream_upsert",
}
LAZY = sorted(set(QUERIES) - JOBS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_worker(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not [word for word in UNWANTED if word in text.replace("Scan ExistingRDD", "RDDScan")]


def test_measuring_filters_reach_the_scan(spark, tmp_path):
    from pagemill.schemas import LISTING_PAGES
    from pagemill.sources import landing
    from tests import pages as P

    path = str(tmp_path / "landing")
    spark.createDataFrame(P.category(1, [2, 1]), LISTING_PAGES).write.parquet(path)
    text = plan(landing.pages_at(landing.read_pages(spark, path), [(1, 1), (2, 7)]))
    assert "PushedFilters: [Or(And(EqualTo(id,1),EqualTo(page,1)),And(EqualTo(id,2),EqualTo(page,7)))]" in text


def test_small_stored_news_leave_the_base_unshuffled(spark, tmp_path):
    from checks import fixtures as fx
    from pagemill.operators.catalog import upsert_keep_last
    from pagemill.sources.snapshots import staged

    rows = fx.catalog(spark, SF)
    text = plan(upsert_keep_last(staged(rows, f"{tmp_path}/b", "1"), staged(rows, f"{tmp_path}/n", "1")))
    base = text[text.index("LeftAnti") :].splitlines()[1]
    assert "BroadcastHashJoin" in text and "FileScan" in base


def test_extraction_does_not_shuffle(spark, tmp_path):
    from pagemill.operators.extract import extract_chunk_rows, extract_listing_rows
    from pagemill.schemas import LISTING_PAGES
    from tests import pages as P

    path = str(tmp_path / "landing")
    spark.createDataFrame(P.category(1, [2, 1]), LISTING_PAGES).write.parquet(path)
    for extract in (extract_chunk_rows, extract_listing_rows):
        assert "Exchange" not in plan(extract(spark.read.schema(LISTING_PAGES).parquet(path)))


def test_log_blocks_keep_their_partitioning(spark):
    from pagemill.operators.resume import stalled_pages

    log = spark.range(100).selectExpr("cast(id % 3 as int) category_id", "cast(id % 5 as int) current_page", "id seq")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(stalled_pages(log))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The rows are exchanged once, by category and block, for the window and the join.
    left = text[text.index("SortMergeJoin") : text.rindex(":")]
    assert left.count("Exchange") == 1


def test_metadata_reads_named_pages_only(spark):
    from pagemill.operators import reconcile
    from pagemill.sources import storage

    from checks import fixtures as fx

    path = storage.shared_dir(spark)
    fx.listing_pages(spark, SF).write.parquet(path)
    metadata = reconcile.crawl_metadata(reconcile.category_domain(spark), spark.read.parquet(path))
    scans = [line for line in plan(metadata).splitlines() if "PushedFilters" in line]
    assert scans and all("EqualTo(page" in line for line in scans)
