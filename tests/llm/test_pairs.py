"""Links and passages against brute force."""

import random
import signal
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import cover_tree, jaccard_join, suffix_dedup
from pagemill.llm.common import Scratch, table
from pagemill.llm.components import components
from tests.llm.conftest import SMALL, WORD, invented

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def least_reachable(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            if root[a] != least or root[b] != least:
                root[a] = root[b] = least
                changed = True
    return root


def jaccard_by_force(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = least_reachable(ids, links)
    return sorted(((i, len(shingles(t)), root.get(i)) for i, t in rows), key=repr)


def jaccard_of(df):
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(df).collect()), key=repr)


def test_jaccard_on_edges(edges, edge_rows):
    assert jaccard_of(edges) == jaccard_by_force([r[:2] for r in edge_rows])


def test_jaccard_on_nothing(nothing):
    assert jaccard_of(nothing) == []


def test_memory_of_a_cell_of_near_copies():
    """A cell links n x n sets; its forest and its lists are all that is held."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 32).astype(np.uint64)
    sets = []
    for _ in range(8000):
        own = base.copy()
        own[rng.integers(32)] = rng.integers(1, 1 << 62)
        sets.append(np.sort(own))
    tracemalloc.start()
    kept = jaccard_join.scan_links(sets[:3000], np.zeros(3000, np.int32), jaccard_join.Rule())
    crossing = jaccard_join.scan_links(sets, np.repeat([0, 1], 4000).astype(np.int32), jaccard_join.Rule())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept) == 2999 and len(crossing) == 7999 and peak < 100 << 20


def test_jaccard_of_small_sets(spark):
    """Sizes around the boundary, where subsets and lists meet."""
    rng, rows = random.Random(4), []
    for k in range(240):
        words = [f"v{rng.randrange(3)}x{j}" for j in range(4 + rng.randrange(16))]
        rows.append((k, " ".join(words)))
        if rng.random() < 0.5:
            words[-1] = "end"
            rows.append((1000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert jaccard_of(df) == jaccard_by_force(rows)


def test_jaccard_of_a_large_group(spark, monkeypatch):
    """Lists and groups beyond what one cell takes."""
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 6)
    monkeypatch.setattr(jaccard_join, "CELL_SHINGLES", 1500)
    rng, base = random.Random(5), invented(9, 80).split()
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(500 + k, " ".join(base[:40]) + " " + invented(50 + k, 60)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert jaccard_of(df) == jaccard_by_force(rows)


def test_boundary_follows_cost():
    rule = jaccard_join.Rule()
    assert jaccard_join.boundary_by_cost({3: 10, 30: 5}, rule) >= 3
    assert jaccard_join.boundary_by_cost({20: 10}, rule) < 20


def test_subsets_mean_links():
    """Sharing a subset key is the link rule, for all small sizes."""
    rule, rng = jaccard_join.Rule(), np.random.default_rng(1)
    universe = rng.integers(1, 1 << 62, 14).astype(np.uint64)
    for _ in range(300):
        a, b = (np.sort(rng.choice(universe, rng.integers(1, 11), replace=False)) for _ in range(2))
        keys = set(jaccard_join._subset_keys(a, rule, 12)) & set(jaccard_join._subset_keys(b, rule, 12))
        share = any(k % 2 == 0 or len(a) != len(b) for k in keys)
        common = len(set(a.tolist()) & set(b.tolist()))
        assert share == (100 * common >= 80 * (len(a) + len(b) - common))


def passages_by_force(rows, n):
    """Places by row key: the id, or for a row without one its number as text."""
    first, count = {}, {}
    named = sorted({(i, t or "") for i, t in rows if i is not None})
    kept = named + [(f"row {k}", t or "") for k, (i, t) in enumerate(rows) if i is None]
    for i, t in kept:
        w = WORD.findall(t)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            count[k] = count.get(k, 0) + 1
            first.setdefault(k, (i, s))
    repeated, later = {}, {}
    for i, t in kept:
        w = WORD.findall(t)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if count[k] > 1:
                repeated.setdefault(i, set()).update(range(s, s + n))
                if first[k] != (i, s):
                    later.setdefault(i, set()).update(range(s, s + n))
    return repeated, later


def words_of(spans):
    return {j for s in spans for j in range(s["start"], s["end"])}


def keyed(df):
    return suffix_dedup.keyed(df, Scratch(df.sparkSession))


@pytest.mark.parametrize("tasks", [1, 7])
def test_passages(spark, edges, edge_rows, tasks):
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = suffix_dedup.spans(keyed(edges)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    repeated, later = passages_by_force([r[:2] for r in edge_rows], 50)
    nameless = {k for k in repeated if isinstance(k, str)}
    assert len(nameless) == 1  # the edges have one row without id that has passages
    name = lambda r: min(nameless) if r["doc_id"] is None else r["doc_id"]
    assert {name(r): words_of(r["repeated"]) for r in got} == repeated
    assert {name(r): words_of(r["later"]) for r in got if r["later"]} == later


def test_passages_with_shifting_ends(spark):
    """Many documents share parts of one passage, from different first to different last words."""
    rng, base = random.Random(8), invented(21, 300, 10**6).split()
    rows = []
    for k in range(60):
        a = rng.randrange(200)
        rows.append((k, invented(100 + k, 20, 10**6) + " " + " ".join(base[a : a + rng.randrange(30, 110)]) + " " + invented(900 + k, 9, 10**6)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.spans(keyed(df)).collect()
    repeated, later = passages_by_force(rows, 50)
    assert {r["doc_id"]: words_of(r["repeated"]) for r in got} == repeated
    assert {r["doc_id"]: words_of(r["later"]) for r in got if r["later"]} == later


def test_cut_keeps_the_rest(spark, edges):
    passage = invented(33, 60)
    rows = [(1, f"first {passage} end"), (2, f"  other\n{passage}\n\nlast é words"), (3, passage), (4, None), (5, "kept")]
    df = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    out = suffix_dedup.cut(df, suffix_dedup.spans(df))
    assert {r[0]: r[1] for r in out.collect()} == {1: rows[0][1], 2: "  other\nlast é words", 3: "", 4: None, 5: "kept"}
    emptied = suffix_dedup.cut(df, suffix_dedup.spans(df), drop_emptied=True)
    assert {r[0] for r in emptied.collect()} == {1, 2, 4, 5}
    with_keys = keyed(edges)
    assert suffix_dedup.cut(with_keys, suffix_dedup.spans(with_keys)).columns == edges.columns


def test_shared_and_missing_ids(spark, nothing):
    """Every document counts: texts that share an id, and rows without one."""
    passage = invented(34, 60)
    rows = [(1, passage + " a"), (2, "b " + passage), (2, "another text"), (None, passage), (None, passage)]
    df = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = suffix_dedup.spans(df).collect()
    assert sorted((r["doc_id"] or 9, len(words_of(r["repeated"])), len(words_of(r["later"]))) for r in got) == [
        (1, 60, 0), (2, 60, 60), (9, 60, 60), (9, 60, 60),
    ]
    out = suffix_dedup.cut(df, suffix_dedup.spans(df)).collect()
    assert sorted(((r[0] or 9), r[1]) for r in out) == [(1, passage + " a"), (2, "another text"), (2, "b "), (9, ""), (9, "")]
    assert suffix_dedup.spans(keyed(nothing)).collect() == []


def test_a_passage_everywhere(spark):
    """One stretch in more suffixes than an Arrow batch holds."""
    passage = invented(35, 55)
    rows = [(k, f"{passage} end{k}" if k % 3 else f"{passage} {passage}") for k in range(12_000)]
    df = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {r["doc_id"]: r for r in suffix_dedup.spans(df).collect()}
    assert len(got) == 12_000
    for k in range(0, 12_000, 37):
        n = 55 if k % 3 else 110
        assert words_of(got[k]["repeated"]) == set(range(n)), k
        assert words_of(got[k]["later"]) == (set(range(n)) if k else set(range(55, 110))), k


VECTORS = "vec_id long, embedding array<float>, label int, node string, cell string, task string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "z", "z", "z") for r in rows], VECTORS).repartition(3)


def near_by_force(rows):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    usable = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and fine(v)]
    unit = {k: np.array(rows[k][1], np.float32).astype(float) for k in usable}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    pairs = [
        (a, b) for a in usable for b in usable
        if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    ]
    degree = dict.fromkeys(range(len(rows)), 0)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    root = least_reachable(range(len(rows)), pairs)
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = min(rows[j][0] for j in usable if root[j] == root[k]) if k in unit else i
        out.append((i, degree[k], c, c is None or c == i))
    return sorted(out, key=repr)


def near_of(df):
    return sorted((tuple(r) for r in cover_tree.near_duplicates(df).collect()), key=repr)


def test_vectors_on_edges(spark):
    a = [1.0, 2.0, 3.0]
    rows = [
        (0, a, 1), (1, a, 1), (2, [2.0, 4.0, 6.0], 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1),
        (8, [float("nan"), 2.0, 3.0], 1), (9, [float("inf"), 2.0, 3.0], 1), (10, [1.0, 2.0], 1), (None, a, 1), (11, a, 1), (11, a, 1),
        (12, [1e-30, 2e-30, 3e-30], 1), (13, [1e30, 2e30, 3e30], 1), (14, [], 1), (15, [-1.0, -2.0, -3.0], 1),
    ]
    assert near_of(vectors(spark, rows)) == near_by_force(rows)
    assert near_of(vectors(spark, [])) == []


def test_vectors_in_cells(spark, monkeypatch):
    """Several upper nodes and blocks per label, clusters of all tightnesses."""
    monkeypatch.setattr(cover_tree, "BLOCK", 24)
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    rng, rows = np.random.default_rng(3), []
    for c in range(14):
        center = rng.normal(size=8)
        for _ in range(25):
            v = center + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.1, 0.25, 0.6])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 3 == 0)))
    df = vectors(spark, rows)
    assert near_of(df) == near_by_force(rows)
    pairs = {tuple(r) for r in cover_tree.near_pairs(df).collect()}
    distinct = {}
    for i, v, label in rows:
        distinct.setdefault((label, tuple(v)), i)
    want = set()
    keys = list(distinct)
    for x in range(len(keys)):
        for y in range(x):
            (la, va), (lb, vb) = keys[x], keys[y]
            if la == lb and np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.93:
                want.add(tuple(sorted((distinct[keys[x]], distinct[keys[y]]))))
    assert pairs == want


def one_direction(dim, seed):
    """Some hundred copies of a vector at different lengths, in single precision, and a few others."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=dim) * rng.uniform(0.5, 2, (600, 1))).astype(np.float32)
    return np.concatenate([x, rng.normal(size=(20, dim)).astype(np.float32), x[:1] * np.float32(2) ** np.arange(-40, 40)[:, None]])


@pytest.mark.parametrize("dim", [2, 8, 64, 768])
def test_trees_of_one_direction_end(dim):
    def stop(*_):
        raise TimeoutError("the tree does not end")

    old = signal.signal(signal.SIGALRM, stop)
    signal.alarm(60)
    try:
        for seed in range(10):
            x = one_direction(dim, seed).astype(np.float64)
            units = x / np.sqrt((x * x).sum(1, keepdims=True))
            found = cover_tree.Links(np.ones(len(x), np.int64))
            tree = cover_tree.build(units, np.arange(len(x)))
            cover_tree.dual(units, tree, tree, 0.93, found)
            linked = units @ units.T >= 0.93
            assert found.counts.tolist() == (linked.sum(1) - linked.diagonal()).tolist()
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, old)


def test_vectors_of_one_direction(spark):
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(one_direction(64, 1))]
    assert near_of(vectors(spark, rows)) == near_by_force(rows)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(500, 600 + i) for i in range(50)] + [(7, 7), (700, 700)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect())
    assert got == {i: 0 for i in range(41)} | {500: 500} | {600 + i: 500 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark), "t").collect() == []


def test_no_pairs_leave_a_group(spark):
    """What a near-copy group hands on is a forest, not its pairs."""
    rows = [(k, [1.0, 0.001 * k, 0.0], 1) for k in range(300)]
    df = vectors(spark, rows)
    _, nodes, points = cover_tree._prepared(df, Scratch(spark))
    found = cover_tree.near_links(points, nodes, 0.93)
    assert found.where("other is not null").count() <= 300
    assert found.agg(F.sum("n")).first()[0] == 300 * 299


def test_whole_small_table(spark):
    documents = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    sizes = {r[0]: r[1] for r in jaccard_join.jaccard_components(documents).collect()}
    assert sizes == {i: len(shingles(t)) for i, t in rows}
