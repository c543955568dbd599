"""Nearest vectors by cosine: exactly against all rows, or by a partitioned index.

**Exact** search takes a stated set of queries in rounds of bounded size.  A round is
broadcast; every row is compared in the task that reads it, in blocks, and a task hands
on at most k rows a query.

The **index** deals all rows out to lists by the nearest of some centres, which are fitted
to a bounded sample.  A query looks into its nearest lists only.  A list with more than
``cell`` rows is cut into cells, and its queries into parts, so that no list, however
large, is in one task; what meets is (cell, part), both of bounded size.

Scores are rounded to nine digits, so that equal vectors tie wherever they are computed;
ties go to the smaller id.  Vectors that are NULL, empty or zero, or hold a NULL or a
non-finite component, take no part, nor do rows without id.  Vectors of another length
than the query's are no neighbours.  Rows that repeat an id and vector count once; a
query's neighbours have other ids.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.scratch import Scratch

#: Numbers of the queries in one broadcast, and of one block of products.
ROUND_NUMBERS, BLOCK_NUMBERS = 1 << 22, 1 << 19
DIGITS = 9
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND = "query_id long, vec_id long, score double"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, unit) of the vectors that take part; ``unit`` has length one, as bytes of doubles."""
    schema = pa.schema([("vec_id", pa.int64()), ("size", pa.int32()), ("unit", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, units = [], [], []
            offsets = batch["embedding"].offsets.to_numpy()
            body = batch["embedding"].values.to_numpy(zero_copy_only=False).astype(np.float64)  # a NULL is NaN
            for i, vec_id in enumerate(batch["vec_id"].to_pylist()):
                x = body[offsets[i] : offsets[i + 1]]
                most = np.abs(x).max(initial=0.0)
                if most > 0 and np.isfinite(most):
                    x = x / most
                    ids.append(vec_id)
                    sizes.append(len(x))
                    units.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, sizes, units), schema, strict=True)], schema=schema)

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null")
    return rows.mapInArrow(run, "vec_id long, size int, unit binary").distinct()


def _matrix(units: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The units, all of one length, as rows of a matrix, where they lie."""
    if isinstance(units, pa.ChunkedArray):
        units = units.combine_chunks()
    if not len(units):
        return np.zeros((0, 1))
    wide = pa.types.is_large_binary(units.type)
    _, offsets, body = units.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[units.offset : units.offset + len(units) + 1]
    return np.frombuffer(body, np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(len(units), -1)


class Best:
    """The k best rows of each query so far, by score and then smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.score = np.full((len(ids), k), -np.inf)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def take(self, ids: np.ndarray, y: np.ndarray) -> None:
        # Blocks are cut on both sides, so that what is held at once does not grow with the queries.
        wide = max(1, 2 * isqrt(BLOCK_NUMBERS))
        step = max(1, BLOCK_NUMBERS // max(1, min(wide, len(self.ids))))
        for b in range(0, len(self.ids), wide):
            for a in range(0, len(ids), step):
                self._take(slice(b, b + wide), ids[a : a + step], y[a : a + step])

    def _take(self, mine: slice, ids: np.ndarray, y: np.ndarray) -> None:
        scores = self.x[mine] @ y.T
        np.round(scores, DIGITS, out=scores)
        scores[self.ids[mine, None] == ids[None, :]] = -np.inf
        # A row enters where it beats the last one that is held.
        some = np.flatnonzero((scores >= self.score[mine, -1:]).any(1))
        if not len(some):
            return
        at, scores, k = some + mine.start, scores[some], self.k
        least = self.score[at, -1]
        if len(ids) > k:
            least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, -k])
        r, c = np.nonzero(scores >= least[:, None])  # ties too
        row = np.concatenate([np.repeat(np.arange(len(at)), k), r])
        score = np.concatenate([self.score[at].ravel(), scores[r, c]])
        named = np.concatenate([self.id[at].ravel(), ids[c]])
        order = np.lexsort((named, -score, row))
        row = row[order]
        first = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        self.score[at], self.id[at] = score[first].reshape(-1, k), named[first].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c = np.nonzero(np.isfinite(self.score))
        return self.ids[q], self.id[q, c], self.score[q, c]


def _first(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, whichever tasks found them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact_topk(units: DataFrame, asked: Column, k: int, scratch: Scratch, name: str = "exact") -> DataFrame:
    """The k nearest of every row for which ``asked`` holds, against all rows of ``units``."""
    queries, parts = units.where(asked), []
    facts = queries.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
    for size, n in sorted(facts):
        rounds = -(-n * size // ROUND_NUMBERS)
        for turn in range(rounds):
            mine = queries.where((F.col("size") == size) & (F.pmod(F.xxhash64("vec_id", "unit"), F.lit(rounds)) == turn))
            held = units.sparkSession.sparkContext.broadcast(mine.select("vec_id", "unit").toArrow().sort_by("vec_id"))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                best = Best(held.value["vec_id"].to_numpy(), _matrix(held.value["unit"]), k)
                for batch in batches:
                    if len(batch):
                        best.take(batch["vec_id"].to_numpy(), _matrix(batch["unit"]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], schema=_FOUND)

            found = units.where(F.col("size") == size).select("vec_id", "unit").mapInArrow(run, FOUND)
            parts.append(scratch.save(_first(found, k), f"{name}-{size}-{turn}"))
    if not parts:
        return _first(units.sparkSession.createDataFrame([], FOUND), k)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@dataclass(frozen=True)
class Index:
    """Bounds of the index: at most ``sample`` rows fit at most ``lists`` centres.

    How many lists a query looks into is measured, not set: vectors in clusters need few,
    vectors without structure nearly all.
    """

    sample: int = 16_384
    lists: int = 4096
    rows_per_list: int = 128
    target: float = 0.93  # share of the true neighbours of a few queries that must be in the lists looked into
    tried: int = 256  # these queries
    cell: int = 8192
    steps: int = 8


def fit_centres(x: np.ndarray, lists: int, steps: int) -> np.ndarray:
    """Spherical k-means of a sample; a centre that no row is near to stays where it was."""
    rng = np.random.default_rng(11)
    centres = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))].copy()
    for _ in range(steps):
        near = (x @ centres.T).argmax(1)
        for c in np.unique(near):
            total = x[near == c].sum(0)
            length = np.sqrt((total * total).sum())
            if length > 0:
                centres[c] = total / length
    return centres


def _listed(units: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(vec_id, unit, list): a row for each of the ``probes`` nearest lists."""
    held = units.sparkSession.sparkContext.broadcast(centres)
    schema = pa.schema([("vec_id", pa.int64()), ("unit", pa.binary()), ("list", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            near = -(_matrix(batch["unit"]) @ held.value.T)
            k = min(probes, near.shape[1])
            lists = np.argpartition(near, k - 1, axis=1)[:, :k].astype(np.int32)
            at = pa.array(np.repeat(np.arange(len(batch)), k))
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(at), batch["unit"].take(at), pa.array(lists.ravel())], schema=schema)

    return units.select("vec_id", "unit").mapInArrow(run, "vec_id long, unit binary, list int")


def probes_needed(rows: DataFrame, asked: Column, centres: np.ndarray, k: int, index: Index, scratch: Scratch) -> int:
    """The least number of nearest lists that hold ``target`` of the true neighbours of some queries."""
    some = rows.where(asked).orderBy(F.xxhash64("vec_id", "unit"), "vec_id").limit(index.tried).toArrow()
    ids = some["vec_id"].to_pylist()
    if not ids:
        return 1
    true = exact_topk(rows, F.col("vec_id").isin(ids), k, scratch, "tried").select("query_id", "vec_id")
    near = true.join(rows.select("vec_id", "unit"), "vec_id").select("query_id", "unit").toArrow()  # tried x k rows
    if not len(near):
        return 1
    row = {vec_id: i for i, vec_id in enumerate(ids)}
    asked_at = np.array([row[i] for i in near["query_id"].to_pylist()])
    lists = (_matrix(near["unit"]) @ centres.T).argmax(1)
    scores = _matrix(some["unit"]) @ centres.T
    rank = 1 + (scores[asked_at] > scores[asked_at, lists][:, None]).sum(1)
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(index.target * len(rank))) - 1)])


def index_topk(units: DataFrame, asked: Column | None, k: int, index: Index, scratch: Scratch) -> DataFrame:
    """The k nearest of the asked rows (all, if None) that the index finds; all rows are in the index."""
    sizes = [r["size"] for r in units.groupBy("size").count().collect()]
    out = _first(units.sparkSession.createDataFrame([], FOUND), k)
    for size in sorted(sizes):
        rows = units.where(F.col("size") == size)
        n = rows.count()
        some = rows.orderBy(F.xxhash64("vec_id", "unit"), "vec_id").limit(min(index.sample, (1 << 24) // size)).toArrow()
        lists = max(1, min(index.lists, n // index.rows_per_list))
        centres = fit_centres(_matrix(some["unit"]), lists, index.steps)
        stored = scratch.save(_listed(rows, centres, 1), f"lists-{size}")
        counts = stored.groupBy("list").agg(F.ceil(F.count("*") / index.cell).cast("int").alias("cells"))  # at most ``lists`` rows
        queries = rows if asked is None else rows.where(asked)
        probes = probes_needed(rows, F.lit(True) if asked is None else asked, centres, k, index, scratch)
        probing = scratch.save(_listed(queries, centres, probes), f"probes-{size}")
        parts = probing.groupBy("list").agg(F.ceil(F.count("*") / index.cell).cast("int").alias("parts"))
        grid = F.broadcast(scratch.save(counts.join(parts, "list"), f"grid-{size}"))
        place = lambda c: F.pmod(F.xxhash64("vec_id", "unit"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        side = stored.join(grid, "list").select("list", place("cells").alias("cell"), every("parts").alias("part"), "vec_id", "unit")
        asking = probing.join(grid, "list").select("list", every("cells").alias("cell"), place("parts").alias("part"), "vec_id", "unit")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            best = Best(left["vec_id"].to_numpy(), _matrix(left["unit"]), k)
            if len(right):
                best.take(right["vec_id"].to_numpy(), _matrix(right["unit"]))
            return pa.table([pa.array(c) for c in best.rows()], schema=_FOUND)

        keys = ["list", "cell", "part"]
        found = asking.groupBy(*keys).cogroup(side.groupBy(*keys)).applyInArrow(meet, FOUND)
        out = out.union(scratch.save(_first(found, k), f"found-{size}"))
    return out


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n, hits): how many of a query's exact neighbours the index found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(hit, ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
