"""Row counts, volume estimates and their reconciliation."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.operators.extract import visible, with_items_page, with_pagination
from pagemill.schemas import CATEGORY_IDS, METADATA_COLUMNS


def category_domain(spark: SparkSession) -> DataFrame:
    return spark.range(CATEGORY_IDS[0], CATEGORY_IDS[-1] + 1, numPartitions=1).select(F.col("id").cast("int"))


def rows_per_page(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "page").agg(F.count("*").alias("n"))


def rows_per_category(page_counts: DataFrame) -> DataFrame:
    return page_counts.groupBy("id").agg(F.count("*").alias("pages"), F.sum("n").alias("size"))


def volume_estimate(page_counts: DataFrame) -> DataFrame:
    """Rows of a category judged by its first and last page only.

    All pages but the last are taken to be as long as the first.
    """
    first = F.coalesce(F.max(F.when(F.col("page") == 1, F.col("n"))), F.lit(0))
    last_page = F.max("page")
    return page_counts.groupBy("id").agg(
        last_page.alias("last_page"),
        ((last_page - 1) * first + F.max_by("n", "page")).cast("bigint").alias("size"),
    )


def first_page_stats(pages: DataFrame) -> DataFrame:
    """Page size, announced last page and rows of the first page; one row per category."""
    shown = with_items_page(with_pagination(visible(pages.where(F.col("page") == 1))))
    first = F.struct("items_page", F.col("last").alias("last_page"), H.row_count(F.col("markup")).alias("first_rows"))
    by_category = shown.select("id", first.alias("first")).groupBy("id")
    return by_category.agg(F.max("first").alias("first")).select("id", "first.*")


def crawl_metadata(
    domain: DataFrame,
    pages: DataFrame,
    first: DataFrame | None = None,
    newest: Callable[[DataFrame], DataFrame] = lambda pages: pages,
) -> DataFrame:
    """Metadata of every category of the domain; what was not seen is zero.

    Only the first and the last page of each category are read: the first ones
    tell where the last ones are, at most one small row per category of the
    domain, and both are literals that reach the scan.  ``first`` may be given, and
    ``newest`` chooses among pages that landed more than once.
    """
    if first is None:
        first = first_page_stats(pages)
    rows = first.join(F.broadcast(domain), "id", "left_semi").collect()
    names = ["id", "items_page", "last_page", "first_rows"]
    known = F.array(*[F.struct(*[F.lit(row[c]).cast("int").alias(c) for c in names]) for row in rows])
    first = domain.limit(1).select(F.inline(known)) if rows else first.where(F.lit(False))
    wanted = F.lit(False)
    for row in rows:
        wanted = wanted | ((F.col("id") == row["id"]) & (F.col("page") == row["last_page"]))
    last_pages = visible(newest(pages.where(wanted)))
    last_counts = last_pages.select("id", H.row_count(F.col("markup")).alias("n"))
    last = last_counts.groupBy("id").agg(F.max("n").alias("last_rows"))
    found = first.join(last, "id").select(
        "id",
        "items_page",
        "last_page",
        ((F.col("last_page") - 1).cast("bigint") * F.col("first_rows") + F.col("last_rows")).alias("size"),
    )
    zero = F.lit(0)
    return domain.join(found, "id", "left").select(
        "id",
        F.coalesce("items_page", zero).alias("items_page"),
        F.coalesce("last_page", zero).alias("last_page"),
        F.coalesce("size", zero.cast("bigint")).alias("size"),
    ).select(*METADATA_COLUMNS)


def crawled(metadata: DataFrame, category_id: int | None = None) -> DataFrame:
    """Metadata of one category, or all of it."""
    return metadata if category_id is None else metadata.where(F.col("id") == category_id)


def empty_categories(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("size") == 0).select("id")


def _status(expected: Column, found: Column) -> Column:
    """``no_local`` only where rows are expected: nothing of nothing is complete."""
    return (
        F.when(expected.isNull(), "no_metadata")
        .when((found == 0) & (expected > 0), "no_local")
        .when(found < expected, "missing")
        .when(found > expected, "excess")
        .otherwise("complete")
    )


def completeness_by_category(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """Expected against found rows per category, with a status.

    A positive ``diff`` is missing rows, a negative one excess.
    """
    expected = metadata.groupBy("id").agg(F.sum("size").cast("bigint").alias("expected"))
    local = catalog.groupBy("id").agg(F.count("*").alias("found"))
    found = F.coalesce(F.col("found"), F.lit(0))
    status = _status(F.col("expected"), found)
    return expected.join(local, "id", "full_outer").select(
        "id", "expected", found.alias("found"), (F.col("expected") - found).alias("diff"), status.alias("status")
    )


def completeness_global(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """The same over all categories, as one row.

    The two totals are summed in one aggregate over their union, which needs no
    join of the two tables.
    """
    none = F.lit(None).cast("bigint")
    totals = metadata.select(F.col("size").cast("bigint").alias("size"), none.alias("row")).unionByName(
        catalog.select(none.alias("size"), F.lit(1).cast("bigint").alias("row"))
    )
    expected, found = F.col("expected"), F.col("found")
    status = _status(expected, found)
    summed = totals.agg(F.sum("size").cast("bigint").alias("expected"), F.count("row").alias("found"))
    return summed.select(expected, found, (expected - found).alias("diff"), status.alias("status"))
