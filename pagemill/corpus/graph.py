"""Which nodes stand near each other in segments: weighted edges, nodes, best edges."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cooccurrence_edges(members: DataFrame, reach: int = 5) -> DataFrame:
    """(a, b, weight): how often two different nodes stand ``reach`` places apart at most, a before b in order.

    ``members`` has ``segment``, ``pos`` (a whole number) and ``node``.  Places are dealt to
    blocks of ``reach``; a member meets those of its own and of the next block only.  So a
    segment of m members gives m * reach pairs, not m * m, and a very long one is split
    over its blocks.  Pairs are counted in the tasks before they are shuffled.  Rows with
    a NULL in one of the three are left out; repeated rows count each.
    """
    rows = members.select("segment", F.col("pos").cast("long"), "node").where("segment is not null and pos is not null and node is not null")
    block = F.floor(F.col("pos") / reach)
    left = rows.select("segment", block.alias("block"), F.col("pos").alias("p"), F.col("node").alias("x"))
    right = rows.select("segment", F.explode(F.array(block, block - 1)).alias("block"), F.col("pos").alias("q"), F.col("node").alias("y"))
    # Of two members in one block each is on both sides; the earlier one is on the left.
    met = left.join(right, ["segment", "block"]).where((F.col("q") >= F.col("p")) & (F.col("q") - F.col("p") <= reach) & (F.col("x") != F.col("y")))
    met = met.where((F.col("q") > F.col("p")) | (F.col("x") < F.col("y")))
    pair = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pair.groupBy("a", "b").agg(F.count("*").alias("weight"))


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").union(back)


def nodes(edges: DataFrame) -> DataFrame:
    """(node, n_edges, weight) of the nodes that have edges."""
    return _both_ways(edges).groupBy("node").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """(node, rank, other, weight): the k heaviest edges of each node, ties to the smaller neighbour.

    A hub's edges are cut to k in every task before they meet (k of 1,000 at most).
    """
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    ranked = _both_ways(edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("node", "rank", "other", "weight")
