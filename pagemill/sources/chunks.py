"""Chunks: rows of landed pages that are not consolidated yet.

The store is a directory of loads, each of them split by category.  A load is
written as a whole under its own name, so writing it again replaces it, and a
page that appears in several loads counts in its newest form only.  One file
per page would be billions of files at scale; here a load has files of the
size adaptive execution aims for, whatever the share of its largest category.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.resume import before_stop
from pagemill.schemas import CATALOG, CHUNKS
from pagemill.sources import storage

_STORED = T.StructType([T.StructField("load", T.StringType()), *CHUNKS.fields])


def write_chunks(rows: DataFrame, root: str, load: str) -> None:
    """Write one load of chunk rows, in place of an earlier one of that name.

    The rows must hold each page in one version only.
    """
    (
        rows.select(*CHUNKS.names)
        .hint("rebalance", "id")
        .sortWithinPartitions("id", "page")
        .write.mode("overwrite")
        .partitionBy("id")
        .parquet(f"{root}/load={load}")
    )


def loads(spark: SparkSession, root: str) -> list[str]:
    names = [n.removeprefix("load=") for n in storage.children(spark, root) if n.startswith("load=")]
    return [n for n in names if storage.exists(spark, f"{root}/load={n}/_SUCCESS")]


def scan_chunks(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame | None:
    """All stored chunk rows with their load, or None when nothing is stored."""
    names = loads(spark, root) if only is None else only
    if not names:
        return None
    paths = [f"{root}/load={n}" for n in names]
    # The load name stays text: a schema is given, so it is not inferred.
    return spark.read.schema(_STORED).option("basePath", root).parquet(*paths).select("load", *CHUNKS.names)


VERSION = ["batch", "load"]


def page_summary(chunks: DataFrame) -> DataFrame:
    """Rows and announced last page of the newest version of each page."""
    versions = chunks.groupBy("id", "page", *VERSION).agg(
        F.count("pos").alias("n"), F.max("last_page").alias("last_page")
    )
    newest = F.max_by(F.struct("n", "last_page"), F.struct(*VERSION)).alias("_newest")
    return versions.groupBy("id", "page").agg(newest).select("id", "page", "_newest.n", "_newest.last_page")


def saved_rows(current: DataFrame) -> DataFrame:
    """Rows of current pages up to the first empty page of their category."""
    empty = current.where(F.col("pos").isNull())
    stops = empty.groupBy(F.col("id").alias("stop_id")).agg(F.min("page").alias("stop"))
    return before_stop(current.where(F.col("pos").isNotNull()), stops)


def catalog_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(*CATALOG.names)


def delete_loads(spark: SparkSession, root: str, names: list[str]) -> int:
    """Drop whole loads; returns directories dropped."""
    return sum(storage.delete(spark, f"{root}/load={n}") for n in names)


def delete_chunks(spark: SparkSession, root: str, category_id: int | None = None) -> int:
    """Drop the chunks of one category, or all of them; returns directories dropped."""
    if category_id is None:
        return int(storage.delete(spark, root))
    return sum(storage.delete(spark, f"{root}/load={n}/id={category_id}") for n in loads(spark, root))
