"""Progress of a harvest: what is done and what is left to do."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.html import next_page

PROGRESS_ORDER = ["timestamp", "current_page"]

# Pages handled as one unit when a category is expanded to its pages.
PAGE_BLOCK = 1_000
# Log positions handled as one unit when neighbours are compared.
LOG_BLOCK = 1_000_000


def progress_entries(pages: DataFrame, timestamp: str) -> DataFrame:
    """Log entries for saved pages ``(id, page, n, last_page)``, one per page."""
    return pages.select(
        F.lit(timestamp).alias("timestamp"),
        F.col("id").alias("category_id"),
        F.col("page").alias("current_page"),
        "last_page",
        F.col("n").cast("int").alias("saved_size"),
    )


def last_progress(progress: DataFrame, order: list[str] = PROGRESS_ORDER) -> DataFrame:
    """The last entry of each category in append order.

    Each category sends one entry per input partition to the shuffle.  With a
    single, unique order column the entry is taken column by column, which
    needs no sort for numbers and timestamps.
    """
    columns = [c for c in progress.columns if c != "category_id"]
    by_category = progress.groupBy("category_id")
    if len(order) == 1:
        return by_category.agg(*[F.max_by(c, order[0]).alias(c) for c in columns])
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return by_category.agg(last).select("category_id", *[f"_last.{c}" for c in columns])


def eligible_categories(domain: DataFrame, metadata: DataFrame) -> DataFrame:
    """Categories that have metadata, of whatever size."""
    return domain.join(metadata, "id", "left_semi")


def resume_plan(metadata: DataFrame, last: DataFrame, force: bool = False) -> DataFrame:
    """What to do with each category that has metadata, and from which page.

    A finished category is skipped before its page size is looked at, since
    its last page may be short.
    """
    entry = last.select("category_id", "current_page", F.col("last_page").alias("logged_last"), "saved_size")
    action = (
        F.when(F.lit(force), "restart")
        .when(F.col("category_id").isNull(), "fresh")
        .when(F.col("current_page") == F.col("logged_last"), "skip")
        .when(~F.col("saved_size").eqNullSafe(F.col("items_page")), "restart")
        .otherwise("resume")
    )
    planned = metadata.join(entry, F.col("id") == F.col("category_id"), "left").withColumn("action", action)
    start = F.when(F.col("action") == "resume", next_page(F.col("current_page"), F.col("logged_last"))).when(
        F.col("action") != "skip", F.lit(1)
    )
    return planned.select("id", "action", start.alias("start_page"))


def missing_pages(metadata: DataFrame, saved: DataFrame, block: int = PAGE_BLOCK) -> DataFrame:
    """Pages up to the last one that were not saved.

    Saved pages become one set of at most ``block`` numbers per block of pages,
    built before the shuffle; only the gaps of a block are expanded to rows.
    Neither side ever lists all the pages of a category in one row.
    """
    block_of = F.floor((F.col("page") - 1) / block)
    done = (
        saved.where(F.col("page") >= 1)
        .groupBy("id", block_of.alias("block"))
        .agg(F.collect_set("page").alias("pages"))
    )
    blocks = metadata.where(F.col("last_page") >= 1).select(
        "id", "last_page", F.explode(F.sequence(F.lit(0), F.floor((F.col("last_page") - 1) / block))).alias("block")
    )
    first = F.col("block") * block + 1
    wanted = F.sequence(first, F.least(first + block - 1, F.col("last_page")))
    none = F.array().cast("array<int>")
    gaps = F.array_except(F.transform(wanted, lambda p: p.cast("int")), F.coalesce("pages", none))
    return blocks.join(done, ["id", "block"], "left").select("id", F.explode(gaps).alias("page"))


def previous_in_log(log: DataFrame, key: str, seq: str, value: str, block: int = LOG_BLOCK) -> DataFrame:
    """``log`` with ``previous``, the value of the entry before it under its key.

    ``seq`` is a unique position.  Neighbours are compared within blocks of
    positions; the last value of each block, one row per key and block, is then
    handed to the block after it.  No window holds a whole key.  Entries without
    a position come first under their key, in no order among themselves; a NULL
    key is a key.
    """
    # Never NULL, so that windows and join deal out the rows alike.
    parts = ["_key", "_none", "_block"]
    blocked = (
        log.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit("")))
        .withColumn("_none", F.col(key).isNull())
        .withColumn("_block", F.coalesce(F.floor(F.col(seq) / block), F.lit(-1)))
    )
    within = Window.partitionBy(*parts).orderBy(seq)
    across = Window.partitionBy("_key", "_none").orderBy("_block")
    ends = blocked.groupBy(*parts).agg(F.max_by(value, seq).alias("_end"))
    carried = ends.select(*parts, F.lag("_end").over(across).alias("_carried"))
    inside = blocked.select("*", F.lag(value).over(within).alias("_before"), F.row_number().over(within).alias("_rank"))
    previous = F.when(F.col("_rank") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return inside.join(carried, parts).select(*log.columns, previous.alias("previous"))


def stalled_pages(
    log: DataFrame, key: str = "category_id", seq: str = "seq", page: str = "current_page", block: int = LOG_BLOCK
) -> DataFrame:
    """Log entries whose page is the same as in the entry before."""
    return previous_in_log(log, key, seq, page, block).where(F.col("previous") == F.col(page)).drop("previous")


def contiguous_prefix(page_counts: DataFrame) -> DataFrame:
    """Pages before the first empty one of their category."""
    stops = (
        page_counts.where(F.col("n") == 0).groupBy(F.col("id").alias("stop_id")).agg(F.min("page").alias("stop"))
    )
    return before_stop(page_counts, stops)


def before_stop(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows of pages before the stop of their category, if it has one.

    Any category counts, NULL too.  ``stops`` has one row per category, so it is
    broadcast: a shuffle by category would bring a large one into one task.
    """
    joined = rows.join(F.broadcast(stops), F.col("id").eqNullSafe(F.col("stop_id")), "left")
    return joined.where(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).select(*rows.columns)
