"""Shards of bounded size by extendible hashing.

A directory is indexed by the leading bits of a hash of the id.  A bucket whose texts
exceed ``limit`` bytes splits on one more bit, and only it; so a bucket of the result
fits, while the one that it was split from did not.  Bytes are summed at a few bits
more than needed in one aggregation, and only rows of buckets that are still too large
are summed again at more bits.  A row finds its bucket by equality with the directory
at each depth that occurs.  All of it is DataFrame expressions.

The hash is 60 bits of the md5 of the id, then 60 bits that differ by row, so that
rows with one id split too, whatever their number.

Defined results: a NULL id hashes as the empty text; a NULL text has 0 bytes; a text
above the limit is alone in its bucket as soon as bits tell it apart, and ``fits`` is
false there; empty buckets are not listed; an empty table has none.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch

BITS = 60
#: Bits that one aggregation looks ahead.
AHEAD = 4


@dataclass(frozen=True)
class Limits:
    shard_bytes: int = 16 << 20


def _bits(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, BITS // 4), 16, 10).cast("long")


def hashed(documents: DataFrame) -> DataFrame:
    """``documents`` with ``_h1``, ``_h2`` and ``_bytes``."""
    own = F.md5(F.concat_ws("/", F.xxhash64("text").cast("string"), F.monotonically_increasing_id().cast("string")))
    return (
        documents.withColumn("_h1", _bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("_h2", _bits(own))
        .withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    )


def _prefix() -> tuple[Column, Column]:
    """The leading ``_depth`` bits: those of the first hash, and those of the second or 0."""
    first = F.expr(f"shiftright(_h1, greatest({BITS} - _depth, 0))")
    second = F.expr(f"case when _depth > {BITS} then shiftright(_h2, {2 * BITS} - _depth) else 0L end")
    return first, second


def at_depth(rows: DataFrame, depth: int) -> DataFrame:
    first, second = _prefix()
    return rows.withColumn("_depth", F.lit(depth)).withColumn("_p1", first).withColumn("_p2", second)


def _parent(level: DataFrame, depth: int) -> DataFrame:
    """Sums of a level one bit shorter."""
    if depth > BITS:
        up = [F.col("_p1"), F.expr("shiftright(_p2, 1)").alias("_p2")]
    else:
        up = [F.expr("shiftright(_p1, 1)").alias("_p1"), F.lit(0).cast("long").alias("_p2")]
    return level.select(*up, "_bytes", "_n").groupBy("_p1", "_p2").agg(F.sum("_bytes").alias("_bytes"), F.sum("_n").alias("_n"))


def directory(rows: DataFrame, limits: Limits, scratch: Scratch) -> DataFrame:
    """(_depth, _p1, _p2, _bytes, _n) of the buckets, from rows (_h1, _h2, _bytes)."""
    whole = f"(_bytes <= {limits.shard_bytes} or _n = 1)"
    total = rows.agg(F.sum("_bytes"), F.count("*")).first()
    if not total[1]:
        return at_depth(rows, 0).select("_depth", "_p1", "_p2", "_bytes", F.lit(0).cast("long").alias("_n"))
    guess = max(total[0] // limits.shard_bytes, 1).bit_length() - 1
    top, active, buckets, done = 0, rows, None, False
    root = rows.sparkSession.range(1).select(
        F.lit(0).alias("_depth"), F.lit(0).cast("long").alias("_p1"), F.lit(0).cast("long").alias("_p2"),
        F.lit(total[0]).cast("long").alias("_bytes"), F.lit(total[1]).cast("long").alias("_n"),
    )
    if total[0] <= limits.shard_bytes or total[1] == 1:
        return scratch.save(root, "buckets-0")
    bottom = min(guess + AHEAD, 2 * BITS)
    while not done:
        level = at_depth(active, bottom).groupBy("_p1", "_p2").agg(F.sum("_bytes").alias("_bytes"), F.count("*").alias("_n"))
        level = scratch.save(level, f"level-{bottom}")
        deepest = level
        for depth in range(bottom, top, -1):
            above = _parent(level, depth)
            up1, up2 = (F.col("_p1"), F.expr("shiftright(_p2, 1)")) if depth > BITS else (F.expr("shiftright(_p1, 1)"), F.lit(0).cast("long"))
            large = above.where(f"not {whole}").select(F.col("_p1").alias("_u1"), F.col("_p2").alias("_u2"))
            own = level.withColumn("_u1", up1).withColumn("_u2", up2).join(large, ["_u1", "_u2"], "left_semi")
            found = own.where(whole if depth < 2 * BITS else "true").select(F.lit(depth).alias("_depth"), "_p1", "_p2", "_bytes", "_n")
            buckets = found if buckets is None else buckets.unionByName(found)
            level = above
        buckets = scratch.save(buckets, f"buckets-{bottom}")
        large = deepest.where(f"not {whole}").select("_p1", "_p2")
        done = bottom == 2 * BITS or large.isEmpty()
        if not done:
            active = at_depth(active, bottom).join(large, ["_p1", "_p2"], "left_semi").select("_h1", "_h2", "_bytes")
            top, bottom = bottom, min(bottom + AHEAD, 2 * BITS)
    return buckets


def shard_name() -> Column:
    """The bits of a bucket; the only bucket of a small table has none."""
    return F.expr(
        f"case when _depth = 0 then '' when _depth <= {BITS} then lpad(bin(_p1), _depth, '0') "
        f"else concat(lpad(bin(_p1), {BITS}, '0'), lpad(bin(_p2), _depth - {BITS}, '0')) end"
    )


def assigned(rows: DataFrame, buckets: DataFrame, limits: Limits) -> DataFrame:
    """``rows`` (with the hashes) and ``shard``, ``depth``, ``shard_bytes``, ``fits``."""
    depths = sorted(r[0] for r in buckets.select("_depth").distinct().collect())  # 121 at most
    named = buckets.select(
        "_depth", "_p1", "_p2", shard_name().alias("shard"), F.col("_bytes").alias("shard_bytes"),
        (F.col("_bytes") <= limits.shard_bytes).alias("fits"),
    )
    tried = rows.withColumn("_depth", F.explode(F.array(*map(F.lit, depths))) if depths else F.lit(0))
    first, second = _prefix()
    tried = tried.withColumn("_p1", first).withColumn("_p2", second)
    found = tried.join(named, ["_depth", "_p1", "_p2"])
    return found.withColumnRenamed("_depth", "depth").drop("_p1", "_p2")


def shards(documents: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, fits) of every row."""
    limits, scratch = limits or Limits(), Scratch(documents.sparkSession)
    rows = scratch.save(hashed(documents).select("doc_id", "_h1", "_h2", "_bytes"), "rows")
    found = assigned(rows, directory(rows.drop("doc_id"), limits, scratch), limits)
    return found.select("doc_id", F.col("_bytes").alias("n_bytes"), "shard", "depth", "shard_bytes", "fits")


def write_shards(documents: DataFrame, path: str, limits: Limits | None = None) -> DataFrame:
    """Write every row to the folder of its shard, one file each; returns the directory.

    Rows are hashed and kept before they are dealt out, so that a repeated task finds
    the same bits.
    """
    limits, scratch = limits or Limits(), Scratch(documents.sparkSession)
    rows = scratch.save(hashed(documents), "rows")
    buckets = directory(rows.select("_h1", "_h2", "_bytes"), limits, scratch)
    found = assigned(rows, buckets, limits).select(*documents.columns, F.concat(F.lit("b"), "shard").alias("shard"))
    found.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
    return buckets.select(shard_name().alias("shard"), F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_rows"))
