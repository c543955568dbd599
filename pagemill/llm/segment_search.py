"""Exact search for the vectors of greatest inner product, by multi-resolution segment statistics.

Components become integers floor(scale * x).  A vector is cut into segments, and of each
segment its mean m and deviation s are kept, for few long segments first and more, shorter
ones after.  The squared distance of two vectors is at least the sum over segments of
length * ((m - m')**2 + (s - s')**2); with the lengths of the vectors, which are known
exactly, this lower bound of the distance is an upper bound of the inner product:
sum of length * (m * m' + s * s').  A pair whose bound stays under the query's k-th best
score so far goes, at the coarsest resolution that shows it; what survives all of them is
multiplied out in integers.

The queries are a stated share of the rows and grow with them, so they are taken in rounds
of a bounded size: one round is broadcast, every row is compared in the task that reads it,
and each task hands on k rows a query at most.  The scores that queries begin with come
from a bounded sample of the rows; they decide the work only.

Equal rows (same id and vector) are one point with a number of copies, and equal vectors
of a task's block are multiplied once.

Defined results: a NULL vector, and one with a NULL or non-finite component, is neither
query nor candidate.  Missing components of a shorter vector count as 0, so an empty
vector scores 0.  A NULL id is no query; as a candidate it comes last among equal scores.
A row that repeats another's id is another row: it is a candidate of that one, and as a
query is answered by itself.  A score beyond a long raises.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch, batches_of

#: Components of the queries of one round, and of the sample.
ROUND_NUMBERS, SAMPLE_NUMBERS = 1 << 22, 1 << 18
#: Rows and queries whose pairs are in memory together.
BLOCK, ASKING = 2048, 512
#: Sums of products below this are exact in doubles.
EXACT = 1 << 53
KINDS = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}
_POINT = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("kind", pa.int32()), ("v", pa.binary())])


@dataclass(frozen=True)
class Search:
    k: int = 5
    scale: int = 256
    coarse: tuple[int, ...] = (1, 4, 16)  # segments of each resolution


def points(vectors: DataFrame, search: Search) -> DataFrame:
    """(vec_id, size, kind, v): whole components in the fewest bytes, of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["embedding"]
            offsets = rows.offsets.to_numpy().astype(np.int64)
            body = rows.values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(body))])  # a NULL is NaN here
            whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & rows.is_valid().to_numpy(zero_copy_only=False)
            out = {c: [] for c in ("size", "kind", "v")}
            some = np.flatnonzero(whole)
            for i in some:
                x = np.floor(body[offsets[i] : offsets[i + 1]] * search.scale)
                most = float(np.abs(x).max()) if len(x) else 0.0
                if most >= 1 << 62:
                    raise ArithmeticError(f"a component of vector {batch['vec_id'][int(i)]} is beyond a long")
                kind = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                out["size"].append(len(x))
                out["kind"].append(kind)
                out["v"].append(x.astype(KINDS[kind]).tobytes())
            yield from batches_of(out | {"vec_id": batch["vec_id"].take(pa.array(some))}, _POINT)

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("embedding is not null")
    found = rows.mapInArrow(run, "vec_id long, size int, kind int, v binary")
    return found.groupBy("vec_id", "size", "kind", "v").agg(F.count("*").alias("copies"))


def matrix(rows: pa.RecordBatch | pa.Table, size: int) -> np.ndarray:
    """The vectors cut or filled to ``size`` components."""
    out = np.zeros((rows.num_rows, size), np.int64)
    for i, (n, kind, v) in enumerate(zip(rows["size"].to_pylist(), rows["kind"].to_pylist(), rows["v"].to_pylist(), strict=True)):
        out[i, : min(n, size)] = np.frombuffer(v, KINDS[kind])[:size]
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each vector the root of length times mean, then times deviation, of each segment.

    The product of two such rows is the bound of the inner product.
    """
    size = x.shape[1]
    edges = np.unique(np.linspace(0, size, min(segments, size) + 1).astype(np.int64))[:-1]
    lengths = np.diff(np.append(edges, size))
    sums = np.add.reduceat(x, edges, axis=1)
    spread = np.add.reduceat(x * x, edges, axis=1) - sums * sums / lengths
    return np.concatenate([sums / np.sqrt(lengths), np.sqrt(np.maximum(spread, 0))], axis=1)


class Round:
    """The queries of one round and the best that is known of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, search: Search):
        self.ids, self.x, self.search = ids, x, search
        self.most = int(np.abs(x).max(initial=0))
        real = x.astype(np.float64)
        self.real, self.norms = real, np.sqrt((real * real).sum(1))
        self.levels = [statistics(real, s) for s in search.coarse] if x.shape[1] else []
        n, k = len(ids), search.k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.zeros((n, k), np.int64)
        self.known = np.zeros((n, k), bool)  # the id is not NULL
        self.filled = np.zeros((n, k), bool)
        self.floor = np.full(n, np.iinfo(np.int64).min)  # what a score must reach

    def exact(self, asked: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products of pairs (query, row of ``y``), in integers."""
        out = np.empty(len(asked), np.int64)
        most = self.most * int(np.abs(y).max(initial=0)) * max(1, y.shape[1])
        if most >= 1 << 63:
            for i, (a, b) in enumerate(zip(asked, rows, strict=True)):
                total = sum(int(p) * int(q) for p, q in zip(self.x[a], y[b], strict=True))
                if not -(1 << 63) <= total < 1 << 63:
                    raise ArithmeticError(f"the score of query {self.ids[a]} is beyond a long")
                out[i] = total
            return out
        left, right = (self.real, y.astype(np.float64)) if most < EXACT else (self.x, y)
        for i in range(0, len(asked), 1 << 15):
            part = slice(i, i + (1 << 15))
            out[part] = np.einsum("ij,ij->i", left[asked[part]], right[rows[part]]).astype(np.int64)
        return out

    def survivors(self, part: slice, y: np.ndarray, levels: list[np.ndarray], norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the queries ``part`` and rows that no resolution rules out."""
        floor = self.floor[part].astype(np.float64)
        asked, rows = np.repeat(np.arange(part.start, part.stop), len(y)), np.tile(np.arange(len(y)), part.stop - part.start)
        dense = True
        for own, other in zip(self.levels, levels, strict=True):
            # Rounding of the bounds is far below this.
            if dense:
                slack = 0.25 + 1e-9 * np.outer(self.norms[part], norms)
                stays = own[part] @ other.T + slack >= floor[:, None]
                if len(asked) == stays.size:
                    stays = stays.ravel()
                else:
                    stays = stays[asked - part.start, rows]
            else:
                slack = 0.25 + 1e-9 * self.norms[asked] * norms[rows]
                stays = np.einsum("ij,ij->i", own[asked], other[rows]) + slack >= self.floor[asked]
            asked, rows = asked[stays], rows[stays]
            dense = 16 * len(asked) >= len(y) * (part.stop - part.start)
        return asked, rows

    def take(self, ids: np.ndarray, known: np.ndarray, copies: np.ndarray, y: np.ndarray) -> None:
        """Compare all queries with these points, in blocks."""
        for first in range(0, len(ids), BLOCK):
            block = slice(first, first + BLOCK)
            different, which = np.unique(y[block], axis=0, return_inverse=True)
            which = which.reshape(-1)
            by = np.argsort(which, kind="stable")  # points of each different vector
            bounds = np.searchsorted(which[by], np.arange(len(different) + 1))
            real = different.astype(np.float64)
            levels = [statistics(real, s) for s in self.search.coarse] if self.levels else []
            norms = np.sqrt((real * real).sum(1))
            for a in range(0, len(self.ids), ASKING):
                part = slice(a, min(a + ASKING, len(self.ids)))
                asked, rows = self.survivors(part, different, levels, norms)
                scores = self.exact(asked, different, rows)
                good = scores >= self.floor[asked]
                asked, rows, scores = asked[good], rows[good], scores[good]
                self._merge(part, asked, scores, first + by, bounds[rows], bounds[rows + 1], ids, known, copies, y)

    def _merge(self, part, asked, scores, order, begins, ends, ids, known, copies, y) -> None:
        """Add the points order[begins:ends] with their scores to the best of the queries ``part``."""
        k = self.search.k
        counts = ends - begins
        pair = np.repeat(np.arange(len(asked)), counts)
        at = order[np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())] if len(pair) else pair
        q, score = asked[pair], scores[pair]
        # A query's own row does not count; equal ids have the same vector only if the vectors are equal.
        own = known[at] & (ids[at] == self.ids[q])
        own[own] = (self.x[q[own]] == y[at[own]]).all(1)
        times = np.minimum(copies[at] - own, k)
        q, score, at = (np.repeat(x, times) for x in (q, score, at))
        if not len(q):
            return
        busy = np.unique(q)
        old_q, old_c = np.nonzero(self.filled[busy])
        old_q = busy[old_q]
        q = np.concatenate([old_q, q])
        score = np.concatenate([self.score[old_q, old_c], score])
        new_id = np.concatenate([self.id[old_q, old_c], ids[at]])
        new_known = np.concatenate([self.known[old_q, old_c], known[at]])
        by = np.lexsort((new_id, ~new_known, -score, q))
        q, score, new_id, new_known = q[by], score[by], new_id[by], new_known[by]
        opens = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(opens, np.diff(np.append(opens, len(q))))
        best = rank < k
        q, rank = q[best], rank[best]
        self.score[q, rank], self.id[q, rank], self.known[q, rank], self.filled[q, rank] = score[best], new_id[best], new_known[best], True
        full = busy[self.filled[busy, k - 1]]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, k - 1])


def _arrays(rows: pa.RecordBatch | pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = rows["vec_id"]
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(), known, rows["copies"].to_numpy(), matrix(rows, size)


_BEST = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def best_of_round(rows: DataFrame, asked: pa.Table, sample: pa.Table, search: Search) -> DataFrame:
    """(q, vec_id, score, rank) of the queries ``asked``, numbered from 0, over all rows."""
    size = max(asked["size"].to_pylist(), default=0)
    held = rows.sparkSession.sparkContext.broadcast((asked, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, some = held.value
        ids, _, _, x = _arrays(queries, size)
        seen = Round(ids, x, search)
        seen.take(*_arrays(some, size))
        floor = seen.floor
        now = Round(ids, x, search)
        now.floor = floor
        for batch in batches:
            now.take(*_arrays(batch, size))
        q, c = np.nonzero(now.filled)
        yield from batches_of(
            {"q": q, "vec_id": pa.array(now.id[q, c], pa.int64(), mask=~now.known[q, c]), "score": now.score[q, c]}, _BEST
        )

    found = rows.select("vec_id", "size", "kind", "v", "copies").mapInArrow(run, "q long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k)


def nearest(vectors: DataFrame, asked: Column, search: Search | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k other rows of each row for which ``asked`` holds.

    ``asked`` is a condition on ``vec_id``.
    """
    search, spark = search or Search(), vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(points(vectors, search), "points")
    queries = rows.where(F.col("vec_id").isNotNull() & asked)
    facts = queries.agg(F.sum(F.col("size") + F.lit(8)).alias("numbers")).first()
    widest = rows.agg(F.max("size")).first()[0] or 1
    rounds = max(1, -(-(facts["numbers"] or 0) // ROUND_NUMBERS))
    mark = F.xxhash64("vec_id", "v")
    sample = rows.orderBy(mark, "vec_id").limit(max(search.k + 1, SAMPLE_NUMBERS // max(1, widest))).toArrow()
    parts = None
    for k in range(rounds):
        table = queries.where(F.pmod(mark, F.lit(rounds)) == k).select("vec_id", "size", "kind", "v", "copies").toArrow()
        table = table.sort_by("vec_id")
        best = best_of_round(rows, table, sample, search)
        names = spark.createDataFrame(
            pa.table({"q": pa.array(range(len(table)), pa.int64()), "query_id": table["vec_id"], "times": table["copies"]}).to_pandas(),
            "q long, query_id long, times long",
        )
        # At most ROUND_NUMBERS / 8 rows of three numbers.
        best = best.join(F.broadcast(names), "q").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        best = scratch.save(best.select("query_id", "rank", "vec_id", "score"), f"best-{k}")
        parts = best if parts is None else parts.union(best)
    return parts
