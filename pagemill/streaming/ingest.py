"""Landed pages as a file stream.

Each micro-batch stores its pages as one load of chunks named after the batch,
so a batch that is replayed replaces its own load.  Consolidation reads all
loads; it keeps the last row per key, which no streaming deduplication does.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.plans.harvest import Workspace, consolidate_chunks, store_pages
from pagemill.schemas import CATEGORY_IDS
from pagemill.sources import landing


def ingest_pages(spark: SparkSession, pages_path: str, space: Workspace, files_per_batch: int = 10_000) -> None:
    """Store all pages that landed since the last call, then stop."""

    def store(pages: DataFrame, batch_id: int) -> None:
        known = pages.where(F.col("id").isin(CATEGORY_IDS))  # as a batch harvest plans the domain only
        store_pages(known, space, f"stream-{batch_id:012d}")

    query = (
        landing.stream_pages(spark, pages_path, files_per_batch)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{space.root}/stream_state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_upsert(spark: SparkSession, pages_path: str, space: Workspace, files_per_batch: int = 10_000) -> str | None:
    """Store what landed and upsert it into the catalog; returns the new run."""
    ingest_pages(spark, pages_path, space, files_per_batch)
    return consolidate_chunks(spark, space, csv=False)
