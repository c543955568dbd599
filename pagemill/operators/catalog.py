"""Union, deduplication and consolidation of catalog rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.operators.skew import HOT_ROWS, rows_of_large_groups
from pagemill.schemas import SEQ_COLUMNS


def scan_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of tables with the same columns, matched by name."""
    for other in others:
        first = first.unionByName(other)
    return first


def keep_last(rows: DataFrame, key: str = "protocol", seq: list[str] = SEQ_COLUMNS) -> DataFrame:
    """One row per key, the last in ``seq`` order.  NULL keys form one group.

    ``max_by`` is combined before the shuffle, so a hot key sends one row per
    input partition however many rows it has.
    """
    others = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*seq)).alias("_last")
    return rows.groupBy(key).agg(last).select(*[F.col(key) if c == key else F.col(f"_last.{c}") for c in rows.columns])


def merge_keep_last(old: DataFrame, new: DataFrame, key: str = "protocol", seq: list[str] = SEQ_COLUMNS) -> DataFrame:
    """Union of old and new rows, one per key: any new row beats an old one."""
    both = scan_union(old.withColumn("_origin", F.lit(0)), new.withColumn("_origin", F.lit(1)))
    return keep_last(both, key, ["_origin", *seq]).drop("_origin")


def upsert_keep_last(base: DataFrame, new: DataFrame, key: str = "protocol", seq: list[str] = SEQ_COLUMNS) -> DataFrame:
    """``merge_keep_last`` for a base that holds each key once already.

    The base is only filtered, not grouped.  When the new rows are a stored
    table under the broadcast threshold, the planner broadcasts their keys by
    that size and the base is not shuffled at all.
    """
    latest = keep_last(new, key, seq)
    keys = latest.select(F.col(key).alias("_key"))
    untouched = base.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return scan_union(untouched, latest)


def consolidate(old: DataFrame | None, new: DataFrame, mode: str = "merge", old_is_unique: bool = False) -> DataFrame:
    """The next catalog.

    ``merge`` deduplicates old and new rows on protocol; ``overwrite``, also
    used when there is no catalog yet, takes the new rows as they are.
    """
    if mode not in ("merge", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "overwrite" or old is None:
        return new
    return upsert_keep_last(old, new) if old_is_unique else merge_keep_last(old, new)


def duplicate_members(
    rows: DataFrame, key: str = "protocol", seq: list[str] = SEQ_COLUMNS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every row of the groups with more than one row, the survivors included."""
    return rows_of_large_groups(rows, key, seq, 2, hot_rows)


def upsert_duplicates(
    base: DataFrame, new: DataFrame, key: str = "protocol", seq: list[str] = SEQ_COLUMNS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``duplicate_members`` of a base that holds each key once, and new rows.

    Only base rows whose key is among the new ones can have a second member,
    so the rest of the base is filtered out before any counting.
    """
    keys = new.select(F.col(key).alias("_key")).distinct()
    touched = base.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return duplicate_members(scan_union(touched, new), key, seq, hot_rows)


def merge_report(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """What a merge dropped, per category, and how many rows had no protocol.

    Rows without a protocol collapse into a single row, so their number tells
    how much a merge may have lost.
    """
    before = rows.groupBy("id").agg(
        F.count("*").alias("rows_in"), F.count_if(F.col("protocol").isNull()).alias("null_protocols")
    )
    after = merged.groupBy("id").agg(F.count("*").alias("rows_kept"))
    kept = F.coalesce(F.col("rows_kept"), F.lit(0))
    return before.join(after, "id", "left").select(
        "id",
        "rows_in",
        kept.alias("rows_kept"),
        (F.col("rows_in") - kept).alias("dropped"),
        "null_protocols",
    )


def without_category(rows: DataFrame, category_id: int | None = None) -> DataFrame:
    """Rows that remain when one category is deleted; None deletes them all."""
    return rows.where(F.lit(False)) if category_id is None else rows.where(F.col("id") != category_id)


def stale_versions(rows: DataFrame, version: list[str]) -> DataFrame:
    """The versions of a page that a newer one replaced, one row per version.

    Rows of a page lie together, so the distinct versions are few already
    before the shuffle; usually there is nothing stale at all.
    """
    newest_first = Window.partitionBy("id", "page").orderBy(*[F.desc(c) for c in version])
    versions = rows.select("id", "page", *version).distinct()
    return versions.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") > 1).drop("_rank")


def without_versions(rows: DataFrame, stale: DataFrame, version: list[str]) -> DataFrame:
    """Rows of other versions; a version with a NULL in it is a version too."""
    columns = ["id", "page", *version]
    named = stale.select(*[F.col(c).alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(named, same, "left_anti")


def latest_pages(rows: DataFrame, version: list[str]) -> DataFrame:
    """Rows of the newest version of each page; a page is replaced as a whole."""
    return without_versions(rows, stale_versions(rows, version), version)
