"""One table from sources of different structure, column by column in order of trust."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_source_merge(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of all sources with the column ``source``; a column that a source lacks is NULL."""
    out = None
    for name, rows in sources.items():
        named = rows.withColumn("source", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def cross_source_join(sources: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """(key, columns, one ``<column>_from`` each, n_sources): the full outer join of the sources.

    ``sources`` are in order of trust.  Each column has the first value that is not NULL
    in that order, and beside it the source that gave it.  Rows that repeat a key within a
    source are one, with the least value of each column.  A NULL key joins nothing: its
    rows stay as they are.

    It is one grouping, not a chain of joins: rows are combined in the tasks, so a key with
    very many rows is one row per input partition, and there is one shuffle for any number
    of sources.
    """
    names = list(sources)
    rows = cross_source_merge(sources).select("source", key, *columns)
    trust = sum((F.when(F.col("source") == name, i).otherwise(0) for i, name in enumerate(names)), F.lit(0))
    # The first of the trusted values: the least (order of trust, value).
    best = [F.min(F.when(F.col(c).isNotNull(), F.struct(trust.alias("trust"), F.col(c).alias("value")))).alias(c) for c in columns]
    number = F.count_distinct("source").alias("n_sources")
    joined = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*best, number)
    name = lambda c: F.get(F.array(*map(F.lit, names)), F.col(f"{c}.trust"))
    split = lambda c: (F.col(f"{c}.value").alias(c), name(c).alias(f"{c}_from"))
    out = joined.select(key, *(x for c in columns for x in split(c)), "n_sources")
    keyless = rows.where(F.col(key).isNull())
    origin = lambda c: F.when(F.col(c).isNotNull(), F.col("source")).alias(f"{c}_from")
    alone = keyless.select(key, *(x for c in columns for x in (F.col(c), origin(c))), F.lit(1).cast("long").alias("n_sources"))
    return out.unionByName(alone)
