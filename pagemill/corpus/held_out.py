"""Benchmark items that stand in documents: containment by word windows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.corpus.names import canonical
from pagemill.sources.scratch import Scratch

#: So many different windows of the benchmark (of one number each) go to every task.
BROADCAST_WINDOWS = 1 << 20


def _words(rows: DataFrame) -> DataFrame:
    """``rows`` with the words of ``text`` as a column by itself, so that they are found once."""
    return rows.withColumn("words", F.filter(F.split(canonical(F.col("text")), " "), lambda w: w != "")).drop("text")


def windows(width: int) -> Column:
    """Different hashes of ``width`` of the ``words`` in a row; of fewer words the whole."""
    inner = F.transform(F.sequence(F.lit(0), F.size("words") - width), lambda i: F.xxhash64(F.slice("words", i + 1, F.lit(width))))
    short = F.when(F.size("words") > 0, F.array(F.xxhash64("words"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size("words") >= width, F.array_distinct(inner)).otherwise(short)


def contained_items(documents: DataFrame, items: DataFrame, scratch: Scratch, width: int = 8, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_common, n_windows): items of which a document holds ``percent`` of the windows.

    Containment is of the item in the document, however long that is.  Windows of
    documents that no item has are dropped in the task that reads them as long as the
    items have at most ``BROADCAST_WINDOWS``; beyond that both sides are dealt out by
    window.  What is left is counted by document and item, in the tasks first.  Every row
    is a document by itself; items that share an id are one item with all their windows;
    NULL and wordless texts hold nothing and are in nothing; an item with fewer words
    than a window is found in a document that has the same few words only.
    """
    of_items = _words(items.where("item_id is not null").select("item_id", "text")).select("item_id", F.explode(windows(width)).alias("window")).distinct()
    of_items = scratch.save(of_items, "item-windows")
    sizes = of_items.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    rows = _words(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    held = rows.select("row", "doc_id", F.explode(windows(width)).alias("window"))
    few = of_items.select("window").distinct().count() <= BROADCAST_WINDOWS
    met = held.join(F.broadcast(of_items) if few else of_items, "window")
    common = met.groupBy("row", "doc_id", "item_id").agg(F.count("*").alias("n_common"))
    found = common.join(sizes, "item_id").where(F.col("n_common") * 100 >= F.col("n_windows") * percent)
    return found.select("doc_id", "item_id", "n_common", "n_windows")


def decontaminate(documents: DataFrame, items: DataFrame, scratch: Scratch, width: int = 8, percent: int = 80) -> DataFrame:
    """``documents`` without the rows that contain an item."""
    keyed = scratch.save(documents.withColumn("_row", F.monotonically_increasing_id()), "keyed-documents")
    found = contained_items(keyed.select(F.col("_row").alias("doc_id"), "text"), items, scratch, width, percent)
    return keyed.join(found.select(F.col("doc_id").alias("_row")), "_row", "left_anti").drop("_row")
