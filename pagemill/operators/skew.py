"""Membership joins that hold up when one key has a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task may take.
HOT_ROWS = 1_000_000


def rows_of_large_groups(
    rows: DataFrame,
    key: str,
    seq: list[str],
    min_rows: int = 2,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All rows whose ``key`` occurs ``min_rows`` times or more; NULL is a key too.

    The group sizes come from a partial aggregation, so a hot key reaches the
    shuffle as one count per input partition.  Rows of every key with ``hot_rows``
    rows or more are then spread over as many salts as their count asks for, and
    only the count table is repeated per salt; no group is ever gathered in one
    task.  Of N rows, at most N / ``hot_rows`` keys are hot, which bounds the
    broadcast: a million keys of 10**12 rows.
    """
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    salts = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")
    hot = F.broadcast(sizes.where(F.col("_n") >= hot_rows).select(F.col("_key").alias("_hot"), salts.alias("_salts")))
    salt = F.when(
        F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*seq), F.col("_salts")).cast("int")
    ).otherwise(F.lit(0))
    salted_rows = rows.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_salt", salt)
    salted_sizes = sizes.join(hot, F.col("_key").eqNullSafe(F.col("_hot")), "left").select(
        "_key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)).alias("_slot")
    )
    member = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_slot"))
    return salted_rows.join(salted_sizes, member, "left_semi").select(*rows.columns)
