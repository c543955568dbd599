"""Landed listing pages.

A page may have landed more than once: again in a later batch or later in the same
one, or as a copy.  It counts once, in the form that landed last.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.schemas import LISTING_PAGES

# The order of landings of a page: batch, time of its file, and the row's place.
LANDING = ["batch", "landed", "at"]
# Packed bytes of pages that one task has to read together.
ROW_GROUP = 2 << 20


def _located(pages: DataFrame) -> DataFrame:
    """Pages with the time at which their file landed and the identity of the landed row."""
    return pages.select(
        *LISTING_PAGES.names,
        F.col("_metadata.file_modification_time").alias("landed"),
        F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("at"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """Add pages to a landing directory.

    A row group is read by one task, and markup packs well: a group of the usual 128 MB
    would hold pages for minutes of extraction, and a landing give work to a few tasks only.
    """
    pages.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return _located(spark.read.schema(LISTING_PAGES).parquet(path))


def stream_pages(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    return _located(spark.readStream.schema(LISTING_PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path))


def identified(pages: DataFrame) -> DataFrame:
    """Pages of a table that is no landing directory: its rows are told apart by their place in it."""
    if "at" in pages.columns:
        return pages
    none = F.lit(None).cast("timestamp")
    return pages.withColumn("landed", none).withColumn("at", F.monotonically_increasing_id())


def newest_pages(pages: DataFrame) -> DataFrame:
    """One row per page, for a few pages: their texts are moved."""
    newest = F.max_by(F.struct("batch", "html"), F.struct(*LANDING)).alias("_newest")
    one = pages.groupBy("id", "page").agg(newest)
    return one.select("id", "page", F.col("_newest.batch").alias("batch"), F.col("_newest.html").alias("html"))


def replaced_landings(pages: DataFrame) -> DataFrame:
    """(id, page, at) of the landed rows that a later landing of their page replaces.

    Found from the keys; no text is read.
    """
    place = F.struct(*LANDING)
    keys = pages.select("id", "page", *LANDING)
    repeated = keys.groupBy("id", "page").agg(F.max(place).alias("_last"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    repeated = repeated.select(F.col("id").alias("_id"), F.col("page").alias("_page"), "_last")
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("page").eqNullSafe(F.col("_page"))
    return keys.join(repeated, same).where(~place.eqNullSafe(F.col("_last"))).select("id", "page", "at")


def pages_at(pages: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """The listed (id, page) pairs, as literals that reach the parquet scan."""
    match = F.lit(False)
    for category_id, page in wanted:
        match = match | ((F.col("id") == category_id) & (F.col("page") == page))
    return newest_pages(pages.where(match))
