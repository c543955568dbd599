from pagemill.operators import reconcile as R
from pagemill.schemas import CATALOG, METADATA


def catalog(spark, counts):
    rows = [(c, 1, f"d{k}", None, None, f"{c}-{k}", None, 0, k) for c, n in counts.items() for k in range(n)]
    return spark.createDataFrame(rows, CATALOG)


def metadata(spark, sizes):
    return spark.createDataFrame([(c, 2, 1, n) for c, n in sizes.items()], METADATA)


def test_status_of_each_category(spark):
    local = catalog(spark, {1: 5, 2: 4, 3: 6, 5: 1})
    crawled = metadata(spark, {1: 5, 2: 5, 3: 5, 4: 5, 6: 0})
    found = {r.id: (r.expected, r.found, r.diff, r.status) for r in R.completeness_by_category(local, crawled).collect()}
    assert found == {
        1: (5, 5, 0, "complete"),
        2: (5, 4, 1, "missing"),
        3: (5, 6, -1, "excess"),
        4: (5, 0, 5, "no_local"),
        5: (None, 1, None, "no_metadata"),
        6: (0, 0, 0, "complete"),
    }


def test_global_status(spark):
    def status(local, crawled):
        (row,) = R.completeness_global(catalog(spark, local), metadata(spark, crawled)).collect()
        return row.diff, row.status

    assert status({1: 2}, {1: 1, 2: 1}) == (0, "complete")
    assert status({1: 1}, {1: 1, 2: 1}) == (1, "missing")
    assert status({1: 3}, {1: 2}) == (-1, "excess")
    assert status({}, {1: 2}) == (2, "no_local")
    assert status({1: 2}, {}) == (None, "no_metadata")


def test_volume_uses_the_first_and_last_page(spark):
    counts = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 2), (2, 1, 4), (3, 2, 5)], "id int, page int, n bigint")
    found = {r.id: (r.last_page, r.size) for r in R.volume_estimate(counts).collect()}
    assert found == {1: (3, 8), 2: (1, 4), 3: (2, 5)}


def test_crawled_filter_treats_zero_as_an_id(spark):
    crawled = metadata(spark, {1: 5, 2: 0})
    assert R.crawled(crawled).count() == 2
    assert R.crawled(crawled, 0).count() == 0
    assert [r.id for r in R.empty_categories(crawled).collect()] == [2]
