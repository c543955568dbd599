"""As many rows of every group, chosen by hash."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.scratch import Scratch

#: Bits of a mark, and of its head, by which it is counted first.
MARK_BITS, HEAD_BITS = 60, 16


def mark(key: Column) -> Column:
    """A number of MARK_BITS from the md5 of a key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, MARK_BITS // 4), 16, 10).cast("long")


def _crossing(counts: DataFrame, by: str, before: Column, k: int) -> DataFrame:
    """Of each group the row in which the running sum of ``n`` reaches k, and the sum before it."""
    running = Window.partitionBy("_group").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("through", before + F.sum("n").over(running))
    return summed.where((F.col("through") >= k) & (F.col("through") - F.col("n") < k)).withColumn("before", F.col("through") - F.col("n"))


def balance(rows: DataFrame, group: str, key: str, k: int, scratch: Scratch) -> DataFrame:
    """``rows`` with k rows of every ``group`` exactly, all of a smaller one: those of the least marks.

    A group is never sorted.  Its rows are counted by the head of their mark, of which
    there are 2**HEAD_BITS; then, in the one head in which the k-th row is, by whole mark.
    That gives a limit per group, and a row is kept by comparing it.  Rows of one mark at
    the limit have one key; as many of them as are still wanted stay, k at most in a task.
    A NULL group is a group; a NULL key has the mark of an empty one.
    """
    head = F.shiftright("_mark", MARK_BITS - HEAD_BITS)
    marked = rows.withColumn("_mark", mark(F.col(key)))
    named = marked.select(F.col(group).alias("_group"), "_mark")
    heads = named.groupBy("_group", head.alias("head")).agg(F.count("*").alias("n"))
    at_head = scratch.save(_crossing(heads, "head", F.lit(0), k).select("_group", "head", "before"), "heads")
    edge = at_head.select(F.col("_group").alias("_of"), F.col("head").alias("_head"), "before")
    inside = named.join(edge, F.col("_group").eqNullSafe(F.col("_of")) & (head == F.col("_head")))
    marks = inside.groupBy("_group", "_mark", "before").agg(F.count("*").alias("n"))
    limits = _crossing(marks, "_mark", F.col("before"), k).select(
        F.col("_group").alias("_of"), F.col("_mark").alias("_limit"), (F.lit(k) - F.col("before")).alias("_wanted")
    )
    limits = scratch.save(limits, "limits")
    judged = marked.join(limits, F.col(group).eqNullSafe(F.col("_of")), "left")
    kept = judged.where(F.col("_limit").isNull() | (F.col("_mark") < F.col("_limit"))).select(*rows.columns)
    turn = F.row_number().over(Window.partitionBy(group).orderBy("_mark"))
    ties = judged.where(F.col("_mark") == F.col("_limit")).withColumn("_turn", turn).where(F.col("_turn") <= k)
    return kept.union(ties.where(F.col("_turn") <= F.col("_wanted")).select(*rows.columns))


def shares(rows: DataFrame, *groups: str) -> DataFrame:
    """(groups, n, share): the share of each group in all rows, to six digits."""
    counts = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(*groups, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
