"""Lines that many texts of a group share: menus, footers, licences."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.sources.scratch import Scratch


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _mark(line: Column) -> Column:
    """What a line is known by; NULL for a blank one."""
    return F.when(strip(line) != "", F.xxhash64(strip(line)))


def common_lines(texts: DataFrame, group: str, least: int, percent: int) -> DataFrame:
    """(group, marks): hashes of the lines that ``least`` texts and ``percent`` of the group's texts hold.

    A line counts once a text, and counts are combined before the shuffle, so one that is
    everywhere is a row per input partition.  The texts of a group hold on average so many
    different lines; 100 / ``percent`` times that number bounds a group's array.
    """
    marks = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _mark), lambda m: m.isNotNull()))
    held = texts.select(F.col(group).alias("_group"), F.explode(marks).alias("mark"))
    counts = held.groupBy("_group", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sizes = texts.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("texts"))
    found = counts.join(sizes, F.col("_group").eqNullSafe(F.col("_of"))).where(F.col("n") * 100 >= F.col("texts") * percent)
    return found.groupBy("_group").agg(F.sort_array(F.collect_list("mark")).alias("marks"))


def drop_boilerplate_lines(texts: DataFrame, group: str, scratch: Scratch, least: int = 3, percent: int = 10) -> DataFrame:
    """``texts`` without the lines that are common in their group, and ``n_dropped``; order is kept.

    The common lines of a group come to its texts as one array, so texts are neither cut
    into rows nor put together again; where the table of arrays is small it is broadcast
    and no text is shuffled, else adaptive execution splits a large group.  A NULL group is
    a group; a NULL text stays NULL; blank lines stay; a column ``n_dropped`` is replaced.
    """
    common = scratch.save(common_lines(texts, group, least, percent), "common-lines")
    rows = texts.drop("n_dropped").join(common, F.col(group).eqNullSafe(F.col("_group")), "left")
    stays = lambda x: F.coalesce(~F.array_contains("marks", _mark(x)), F.lit(True))
    all_lines, kept = _lines(F.col("text")), F.filter(_lines(F.col("text")), stays)
    changed = F.col("marks").isNotNull() & F.col("text").isNotNull()
    dropped = F.when(changed, F.size(all_lines) - F.size(kept)).otherwise(F.lit(0))
    out = rows.withColumn("n_dropped", dropped)
    return out.withColumn("text", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text"))).drop("_group", "marks")
