"""Near-duplicate vectors: pairs within a cosine threshold, by dual traversal of cover trees.

Unit vectors are compared by their chord, which is a metric, so a node of a tree (a
point and the radius that covers its descendants) bounds all distances below it.  The
upper levels are nested nets with halving radii over a bounded sample of each large
label; every vector falls to its nearest node, and pairs of nodes that are further
apart than their covering radii and the threshold are never dealt out.  What remains
is dealt out in blocks of bounded size.  Each task builds the lower levels of its one
or two blocks and descends both trees at once: a pair of nodes is dropped when its
radii rule links out, counted as a whole when they make every pair a link, and
compared exactly, in double precision, at the points.

Vectors link only under equal labels (and lengths) that are not NULL.  Equal vectors
are one point with a weight.  Tasks hand on numbers of links and a spanning forest.

Defined results: a NULL or zero vector, one with NULL or non-finite components, and
one with a NULL label or id links with nothing and is kept; rows that repeat an id are
vectors of their own; with a NULL id the component is NULL; other columns are ignored.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch
from pagemill.llm.components import components, forest

#: Points of one block, of a leaf, and of the sample of a label that upper nodes are chosen from.
BLOCK, LEAF, SAMPLE = 1024, 48, 256
#: Upper nodes of one label, and of all labels together; further labels are one node.
NODES, ALL_NODES = 64, 1 << 14
#: Above the noise of a chord near 0: the root of a product's error, some 1e-13 at most.
SLACK = 1e-6


@dataclass
class Node:
    """A point and what is below it; ``children`` are nodes, or none at a leaf."""

    center: int
    radius: float
    points: np.ndarray
    children: list["Node"]


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def build(x: np.ndarray, points: np.ndarray, reach: float = 1.0) -> Node:
    """The cover tree of ``points``: children are more than ``reach`` apart, which halves by level.

    Points of nearly one direction, closer than chords can tell, are a leaf of any number.
    """
    center = int(points[0])
    away = chord(x[points] @ x[center])
    node = Node(center, float(away.max()), points, [])
    if len(points) <= LEAF or node.radius <= SLACK:
        return node
    while reach >= node.radius:
        reach /= 2
    rest = points
    while len(rest):
        near = chord(x[rest] @ x[rest[0]]) <= reach
        near[0] = True  # whatever its own product with itself
        node.children.append(build(x, rest[near], reach / 2) if near.sum() > 1 else Node(int(rest[0]), 0.0, rest[:1], []))
        rest = rest[~near]
    return node


def net(x: np.ndarray, most: int) -> np.ndarray:
    """Nested nets with halving radii: at most so many of the points, coarse ones first."""
    chosen, reach = [0], 1.0
    while len(chosen) < min(most, len(x)) and reach > 1e-3:
        away = chord(x @ x[chosen].T).min(1)
        while len(chosen) < most and len(left := np.flatnonzero(away > reach)):
            chosen.append(int(left[0]))
            away = np.minimum(away, chord(x @ x[left[0]]))
        reach /= 2
    return np.array(chosen)


class Links:
    """What a traversal finds: weighted numbers of links, and the pairs, block by block."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.counts = np.zeros(len(weights), np.int64)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.counts, a, self.weights[b])
        np.add.at(self.counts, b, self.weights[a])
        self.a.append(a)
        self.b.append(b)


def dual(x: np.ndarray, left: Node, right: Node, cosine: float, found: Links) -> None:
    """All pairs between two trees, or within one if both are the same node."""
    limit = math.sqrt(2 - 2 * cosine)
    stack = [(left, right)]
    while stack:
        p, q = stack.pop()
        same = p is q
        if not p.children and not q.children:
            _compare(x, p.points, q.points, same, cosine, found)
            continue
        ps = p.children or [p]
        qs = ps if same else (q.children or [q])
        if not same and p.children and q.children and max(p.radius, q.radius) > 4 * min(p.radius, q.radius):
            ps, qs = (ps, [q]) if p.radius > q.radius else ([p], qs)
        pc, qc = np.array([n.center for n in ps]), np.array([n.center for n in qs])
        pr, qr = np.array([n.radius for n in ps]), np.array([n.radius for n in qs])
        single_p, single_q = np.array([len(n.points) == 1 for n in ps]), np.array([len(n.points) == 1 for n in qs])
        likeness = x[pc] @ x[qc].T
        open_ = chord(likeness) <= limit + pr[:, None] + qr[None, :] + SLACK
        points = single_p[:, None] & single_q[None, :]
        if same:
            open_ &= np.triu(np.ones_like(open_))
            points &= ~np.eye(len(ps), dtype=bool)
        a, b = np.nonzero(open_ & points & (likeness >= cosine))
        if len(a):
            found.add(pc[a], qc[b])
        for i, j in zip(*np.nonzero(open_ & ~points), strict=True):
            if same and i == j and len(ps[i].points) == 1:
                continue
            stack.append((ps[i], qs[j]))


def _compare(x: np.ndarray, p: np.ndarray, q: np.ndarray, same: bool, cosine: float, found: Links) -> None:
    linked = x[p] @ x[q].T >= cosine
    if same:
        linked = np.triu(linked, 1)
    a, b = np.nonzero(linked)
    if len(a):
        found.add(p[a], q[b])


def points_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, node, label, dim, x) of all rows; the node is NULL where nothing can link."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), x.alias("x"), known.alias("known"))
    node = F.when(F.col("known"), F.xxhash64("label", "x"))
    return rows.select("vec_id", node.alias("node"), "label", F.size("x").alias("dim"), "x")


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of equal length; scaled first, so that squares neither vanish nor overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def upper_nodes(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Unit vectors of the upper nodes of the largest labels; ALL_NODES of them at most."""
    spaces = classes.groupBy("label", "dim").count().where(F.col("count") > BLOCK)
    large = spaces.orderBy(F.desc("count"), "label", "dim").limit(ALL_NODES // 2).collect()
    wanted, total = {}, 0
    for r in large:
        k = min(NODES, -(-r["count"] // BLOCK))
        if k > 1 and total + k <= ALL_NODES:
            wanted[r["label"], r["dim"]] = k
            total += k
    if not wanted:
        return {}
    spark = classes.sparkSession
    keys = spark.createDataFrame(list(wanted), "label string, dim int")
    # The least hashes of each label: partial aggregates of at most SAMPLE rows a task.
    turn = F.row_number().over(Window.partitionBy("label", "dim").orderBy(F.xxhash64("node"), "node"))
    rows = classes.join(F.broadcast(keys), ["label", "dim"]).select("label", "dim", "node", "x")
    per = max(8, min(SAMPLE, (ALL_NODES * 4) // len(wanted)))
    sample = rows.withColumn("turn", turn).where(F.col("turn") <= per).collect()
    by_space: dict[tuple[str, int], list] = {}
    for r in sorted(sample, key=lambda r: (r["label"], r["dim"], r["turn"])):
        by_space.setdefault((r["label"], r["dim"]), []).append(r["x"])
    out = {}
    for space, xs in by_space.items():
        units = _units(pa.array(xs, pa.list_(pa.float64())), space[1])
        out[space] = units[net(units, wanted[space])]
    return out


def assign(classes: DataFrame, nodes: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """(label, dim, cell, away, node, w, u): each point under its nearest upper node."""
    held = classes.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch["label"].to_pylist(), batch["dim"].to_numpy()
            groups: dict[tuple[str, int], list[int]] = {}
            for i, space in enumerate(zip(labels, dims.tolist(), strict=True)):
                groups.setdefault(space, []).append(i)
            for (label, dim), rows in groups.items():
                take = pa.array(rows)
                units = _units(batch["x"].take(take), dim)
                cell, away = np.zeros(len(rows), np.int32), np.full(len(rows), 2.0)
                if (label, dim) in held.value:
                    near = units @ held.value[label, dim].T
                    cell = near.argmax(1).astype(np.int32)
                    away = chord(near.max(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([label] * len(rows), pa.string()),
                        pa.array([dim] * len(rows), pa.int32()),
                        pa.array(cell),
                        pa.array(away),
                        batch["node"].take(take),
                        batch["w"].take(take),
                        pa.array([u.tobytes() for u in units], pa.binary()),
                    ],
                    names=["label", "dim", "cell", "away", "node", "w", "u"],
                )

    return classes.select("label", "dim", "node", "w", "x").mapInArrow(
        run, "label string, dim int, cell int, away double, node long, w long, u binary"
    )


def dealt(points: DataFrame, nodes: dict[tuple[str, int], np.ndarray], cosine: float) -> DataFrame:
    """(task, side, space, node, w, u): blocks, and pairs of blocks whose nodes are near enough."""
    spark, limit = points.sparkSession, math.sqrt(2 - 2 * cosine)
    space = F.concat_ws("/", "dim", "label")
    rows = points.withColumn("space", space).drop("label", "dim")
    cells = rows.groupBy("space", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    totals = cells.groupBy("space").agg(F.sum("n").alias("total"))
    cells = cells.join(totals, "space").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    few = F.col("total") <= BLOCK // 2
    bins = cells.where(few).agg(F.ceil(F.sum("n") * 2 / BLOCK).cast("int").alias("k")).first()["k"] or 1
    # Distances of upper nodes of a label; NODES of each at most.
    apart = [
        (f"{dim}/{label}", i, j, float(d))
        for (label, dim), u in nodes.items()
        for (i, j), d in np.ndenumerate(chord(u @ u.T))
        if i < j
    ]
    apart = spark.createDataFrame(apart, "space string, c1 int, c2 int, apart double")
    large = cells.where(~few).select("space", "cell", "radius", "parts")
    one = large.select("space", F.col("cell").alias("c1"), F.col("radius").alias("r1"), F.col("parts").alias("p1"))
    two = large.select("space", F.col("cell").alias("c2"), F.col("radius").alias("r2"), F.col("parts").alias("p2"))
    near = one.join(two, "space").join(apart, ["space", "c1", "c2"], "left")
    near = near.where(f"c1 = c2 or (c1 < c2 and apart <= r1 + r2 + {limit + SLACK})")
    near = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p1") - 1)))
    near = near.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("p2") - 1))).where("c1 < c2 or i <= j")
    near = near.withColumn("task", F.concat_ws("/", "c1", "i", "c2", "j", "space"))
    first = near.select("space", F.col("c1").alias("cell"), F.col("i").alias("part"), "task", F.lit(0).alias("side"))
    second = near.where("c1 < c2 or i < j").select("space", F.col("c2").alias("cell"), F.col("j").alias("part"), "task", F.lit(1).alias("side"))
    placed = rows.join(cells.select("space", "cell", "parts", few.alias("few")), ["space", "cell"])
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = placed.withColumn("part", part)
    alone = placed.where("few").select(
        F.pmod(F.xxhash64("space"), F.lit(bins)).cast("string").alias("task"), F.lit(0).alias("side"), "space", "node", "w", "u"
    )
    paired = placed.where("not few").join(first.union(second), ["space", "cell", "part"])
    return alone.union(paired.select("task", "side", "space", "node", "w", "u"))


def task_links(table: pa.Table, cosine: float) -> tuple[np.ndarray, Links]:
    """The links within a block, between the two blocks of a task, or within each of many small labels."""
    spaces = table["space"].to_pylist()
    sides = table["side"].to_numpy()
    ids = table["node"].to_numpy()
    found = Links(table["w"].to_numpy())
    by_space: dict[str, list[int]] = {}
    for i, s in enumerate(spaces):
        by_space.setdefault(s, []).append(i)
    vectors = table["u"].to_pylist()
    for rows in by_space.values():
        x = np.stack([np.frombuffer(vectors[i]) for i in rows])
        local = Links(found.weights[rows])
        own = sides[rows]
        left = build(x, np.flatnonzero(own == 0))
        right = build(x, np.flatnonzero(own == 1)) if (own == 1).any() else left
        dual(x, left, right, cosine, local)
        at = np.array(rows)
        found.counts[at] += local.counts
        found.a += [at[a] for a in local.a]
        found.b += [at[b] for b in local.b]
    return ids, found


def near_links(points: DataFrame, nodes: dict[tuple[str, int], np.ndarray], cosine: float) -> DataFrame:
    """(node, n, other): weighted numbers of links (other NULL), and a forest of links (n NULL)."""

    def run(table: pa.Table) -> pa.Table:
        ids, found = task_links(table, cosine)
        some = np.flatnonzero(found.counts)
        a = np.concatenate(found.a) if found.a else np.zeros(0, np.int64)
        b = np.concatenate(found.b) if found.b else np.zeros(0, np.int64)
        tree = np.array(forest(len(ids), a, b), np.int64).reshape(-1, 2)
        return pa.table(
            {
                "node": pa.concat_arrays([pa.array(ids[some]), pa.array(ids[tree[:, 0]])]),
                "n": pa.concat_arrays([pa.array(found.counts[some]), pa.nulls(len(tree), pa.int64())]),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[tree[:, 1]])]),
            }
        )

    return dealt(points, nodes, cosine).groupBy("task").applyInArrow(run, "node long, n long, other long")


def near_pairs(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(a, b): the linked pairs of different vectors, by the least vec_id of each; copies are not expanded."""
    classes, nodes, points = _prepared(embeddings, Scratch(embeddings.sparkSession))

    def run(table: pa.Table) -> pa.Table:
        ids, found = task_links(table, cosine)
        a = np.concatenate(found.a) if found.a else np.zeros(0, np.int64)
        b = np.concatenate(found.b) if found.b else np.zeros(0, np.int64)
        return pa.table({"x": pa.array(ids[a]), "y": pa.array(ids[b])})

    pairs = dealt(points, nodes, cosine).groupBy("task").applyInArrow(run, "x long, y long")
    named = classes.select("node", "first")
    pairs = pairs.join(named.toDF("x", "p"), "x").join(named.toDF("y", "q"), "y")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _prepared(embeddings: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict, DataFrame]:
    rows = points_of(embeddings).where("node is not null")
    classes = rows.groupBy("node", "label", "dim").agg(F.min("vec_id").alias("first"), F.count("*").alias("w"), F.first("x").alias("x"))
    classes = scratch.save(classes, "classes")
    nodes = upper_nodes(classes)
    return classes, nodes, scratch.save(assign(classes, nodes), "points")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    scratch = Scratch(embeddings.sparkSession)
    classes, nodes, points = _prepared(embeddings, scratch)
    found = scratch.save(near_links(points, nodes, cosine), "links")
    counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    named = components(edges, scratch, "components")
    members = classes.select("node", "first", "w").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = members.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = members.join(least, "component").join(counts, "node", "left")
    answer = answer.select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    rows = points_of(embeddings).select("vec_id", "node").join(answer, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
