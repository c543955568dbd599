"""Operators on vectors, names, pages, lines and groups: edges and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.corpus import drift, graph, held_out, integrity, lines, names, pages, sampling, vectors
from pagemill.operators import across
from pagemill.sources.scratch import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- vectors


def unit_rows(spark, rows):
    return vectors.unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))


def nearest_by_force(rows, asked, k):
    units = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.float64(np.float32(v))
            units[i, tuple(v)] = x / np.linalg.norm(x)
    out = []
    for (i, v), x in units.items():
        if asked(i):
            scores = sorted((-round(float(x @ y), 9), j) for (j, w), y in units.items() if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def test_nearest_on_edges(spark, scratch):
    a = [1.0, 2.0, 3.0]
    rows = [(0, a), (1, a), (2, [2.0, 4.0, 6.0]), (3, None), (4, [0.0] * 3), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (None, a),
            (7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, []), (10, [-1.0, -2.0, -3.0]), (11, [3e38, 3e38, 0.0]), (1, a)]
    units = scratch.save(unit_rows(spark, rows), "units")
    want = nearest_by_force(rows, lambda i: True, 3)
    for found in (vectors.exact_topk(units, F.lit(True), 3, scratch), vectors.index_topk(units, None, 3, vectors.Index(target=1.0), scratch)):
        assert [r[:3] for r in rows_of(found)] == [r[:3] for r in want]
    none = scratch.save(unit_rows(spark, []), "none")
    assert vectors.exact_topk(none, F.lit(True), 3, scratch).collect() == [] == vectors.index_topk(none, None, 3, vectors.Index(), scratch).collect()


def test_index_in_cells(spark, scratch, monkeypatch):
    """Clusters, one of them large, in lists that are cut; one round of queries at a time."""
    monkeypatch.setattr(vectors, "ROUND_NUMBERS", 300)
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 500)
    rng, rows = np.random.default_rng(2), []
    for c in range(20):
        center = rng.normal(size=6)
        for _ in range(150 if c == 0 else 25):
            rows.append((len(rows), [float(np.float32(x)) for x in center + 0.1 * rng.normal(size=6)]))
    units = scratch.save(unit_rows(spark, rows), "units")
    exact = vectors.exact_topk(units, F.col("vec_id") % 7 == 0, 5, scratch)
    assert [r[:3] for r in rows_of(exact)] == [r[:3] for r in nearest_by_force(rows, lambda i: i % 7 == 0, 5)]
    found = vectors.index_topk(units, F.col("vec_id") % 7 == 0, 5, vectors.Index(rows_per_list=30, cell=40, sample=200), scratch)
    got = vectors.recall(found, exact).agg(F.sum("n"), F.sum("hits")).first()
    assert got[0] == exact.count() and got[1] >= 0.9 * got[0]


def test_what_a_block_holds_does_not_grow_with_the_queries():
    import tracemalloc

    import pyarrow as pa

    rng, most = np.random.default_rng(3), []
    y = rng.normal(size=(400, 8))
    for n in (4_000, 64_000):
        x = rng.normal(size=(n, 8))
        best = vectors.Best(np.arange(n) + 1000, x, 3)
        tracemalloc.start()
        best.take(np.arange(400), y)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        at = rng.integers(0, n, 20)
        want = np.argsort(-(x[at] @ y.T), axis=1)[:, :3]
        assert (best.id[at] == want).all()
    assert most[1] < 1.5 * most[0]
    part = pa.array([v.tobytes() for v in y], pa.binary()).slice(3, 50)
    assert (vectors._matrix(part) == y[3:53]).all() and (vectors._matrix(pa.chunked_array([part, part]))[50:] == y[3:53]).all()


# --- names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("most", "long"), [(1, 4096), (2, 5)])
def test_similar_names(spark, scratch, monkeypatch, most, long):
    monkeypatch.setattr(names, "LONG", long)
    rng = random.Random(most)
    found = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))) for _ in range(120)] + ["A  b", "a b", None, "", " \t", "x"]
    df = spark.createDataFrame([(x, 1) for x in found], "name string, n int").repartition(3)
    known = {}
    for x in found:
        if key := " ".join((x or "").lower().split()):
            known[key] = known.get(key, 0) + 1
    want = [(a, b, edits(a, b), known[a], known[b]) for a in known for b in known if a < b and edits(a, b) <= most]
    assert rows_of(names.similar_names(df, most, scratch)) == sorted(want, key=repr)


def test_dictionary_takes_the_leftmost_and_longest(spark, scratch):
    known = spark.createDataFrame([("New York",), ("new york city",), ("york",), ("city hall",), ("new  york",), (None,), (" . ",), ("é",)], "name string")
    texts = [(1, "New York City Hall, york"), (2, None), (3, ""), (4, "new. york é É"), (4, "york york"), (None, "city hall"), (5, "newyork")]
    df = spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, entity string").repartition(3)
    assert rows_of(names.dictionary_entities(df, known, scratch)) == sorted([
        (1, 0, 3, "new york city"), (1, 4, 1, "york"), (4, 0, 2, "new york"), (4, 2, 1, "é"), (4, 0, 1, "york"), (4, 1, 1, "york"), (None, 0, 2, "city hall"),
    ], key=repr)
    empty = spark.createDataFrame([], "name string")
    assert names.dictionary_entities(df, empty, scratch).collect() == []


def entities_by_force(texts, known):
    dictionary, out = {tuple(k.split()) for k in known}, []
    for doc_id, text in texts:
        w, at = (text or "").split(), 0
        while at < len(w):
            size = max((n for n in range(1, 6) if tuple(w[at : at + n]) in dictionary and at + n <= len(w)), default=0)
            if size:
                out.append((doc_id, at, size, " ".join(w[at : at + size])))
            at += max(1, size)
    return sorted(out, key=repr)


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_dictionary_by_force(spark, scratch, monkeypatch, held):
    monkeypatch.setattr(names, "HELD", held, raising=False)
    rng = random.Random(held)
    known = [" ".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 5]))) for _ in range(25)]
    known = [k for k in known if k not in ("a", "b")]
    texts = [(i // 2, " ".join(rng.choice("abcdéx") for _ in range(rng.choice([0, 1, 4, 60])))) for i in range(80)] + [(99, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = names.dictionary_entities(df, spark.createDataFrame([(k,) for k in known], "name string"), scratch)
    assert rows_of(found) == entities_by_force(texts, known)
    # A text is matched in the task that reads it.
    source = names.dictionary_entities(spark.range(9).selectExpr("id doc_id", "'a b' text"), spark.createDataFrame([("a b",)], "name string"), scratch)
    assert ("Exchange" in source._jdf.queryExecution().executedPlan().toString()) == (not held)


# --- pages and lines

PAGE = """<!DOCTYPE html><html><head><title> A &amp;
 B </title><style>p{}</style><script>var t="</p><a href='/no'>";</script></head>
<body><!-- <a href="/hidden">x</a> --><h1>Head</h1><p>one <b>bold</b>
two<br>three</p><ul><li><a href="/x?a=1&amp;b=2">Link <i>one</i></a></li><li><a>none</a><a href='/y'>two</a> &copy; <a href=/z class="c>d">z</a></ul>
<p>open <a href="/never"></body></html>"""


def test_page_reading(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain &lt; text\n\nmore"), (5, "<title>only"), (6, "<title> </title><p>")], "page_id long, html string")
    assert {r[0]: r[1] for r in pages.page_title(df).collect()} == {1: "A & B", 2: None, 3: None, 4: None, 5: "only", 6: None}
    text = {r["page_id"]: (r["n_lines"], r["text"]) for r in pages.page_text(df).collect()}
    assert text[1] == (6, "Head\none bold two\nthree\nLink one\nnonetwo © z\nopen")
    assert text[2] == text[3] == (0, "") and text[4] == (1, "plain < text more") and text[6] == (0, "")
    assert rows_of(pages.page_links(df)) == [(1, 0, "/x?a=1&b=2", "Link one"), (1, 1, None, "none"), (1, 2, "/y", "two"), (1, 3, "/z", "z")]


def test_hosts(spark):
    urls = ["http://A.example.com:80/x", "https://u:p@b.example/?q", "mailto:x", None, "http:///x", "//c/d"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(pages.host(F.col("url"))).collect()
    assert [r[0] for r in got] == ["a.example.com", "b.example", None, None, None, None]


def test_boilerplate(spark, scratch):
    rows = [(k, "h" if k < 8 else None, f"menu \nown {k}\n\n menu\nfooter{k % 2}") for k in range(10)] + [(20, "h", None), (21, "h", ""), (22, "one", "menu")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "id long, host string, text string, mark string, n_dropped int").repartition(3)
    got = {r["id"]: (r["text"], r["n_dropped"]) for r in lines.drop_boilerplate_lines(df, "host", scratch, least=3, percent=50).collect()}
    assert got[0] == ("own 0\n\nfooter0", 2) and got[9][1] == 0  # two texts of the missing host are too few
    assert got[20] == (None, 0) and got[21] == ("", 0) and got[22] == ("menu", 0) and len(got) == 13
    assert lines.drop_boilerplate_lines(df.limit(0), "host", scratch).collect() == []


# --- held-out items


def test_contained_items(spark, scratch, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, "few words"), (3, None), (4, ""), (None, item)], "item_id long, text string")
    cut = " ".join(f"w{i}" for i in range(25))
    docs = [(1, f"x {item.upper()}. y"), (2, cut), (3, "Few, WORDS"), (4, "few words more"), (5, None), (6, ""), (1, "clean text here"), (None, item)]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, words string").repartition(3)
    for few in (1 << 20, 0):
        monkeypatch.setattr(held_out, "BROADCAST_WINDOWS", few)
        assert rows_of(held_out.contained_items(df, items, scratch)) == sorted([(1, 1, 23, 23), (3, 2, 1, 1), (None, 1, 23, 23)], key=repr)
    assert [r[:2] for r in rows_of(held_out.contained_items(df, items, scratch, percent=70)) if r[0] == 2] == [(2, 1)]
    kept = rows_of(held_out.decontaminate(df, items, scratch))
    assert kept == sorted([(*d, "z") for d in docs if d[1] not in (docs[0][1], docs[2][1], item)], key=repr)


# --- graph


def test_edges(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3]), p, rng.randrange(6)) for p in range(60) for _ in range(rng.randrange(3))] + [(None, 1, 1), (1, None, 2), (1, 3, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "segment int, pos int, node int, block string").repartition(3)
    want = {}
    whole = [r for r in rows if None not in r]
    for i, (s, p, x) in enumerate(whole):
        for t, q, y in whole[i + 1 :]:
            if s == t and abs(p - q) <= 4 and x != y:
                want[min(x, y), max(x, y)] = want.get((min(x, y), max(x, y)), 0) + 1
    edges = graph.cooccurrence_edges(df, 4)
    assert rows_of(edges) == sorted(((*k, w) for k, w in want.items()), key=repr)
    both = [(a, b, w) for (a, b), w in want.items()] + [(b, a, w) for (a, b), w in want.items()]
    top = [(n, r + 1, o, w) for n in range(6) for r, (w, o) in enumerate(sorted(((-w, b) for a, b, w in both if a == n))[:2])]
    assert rows_of(graph.top_edges(edges, 2)) == sorted(((n, r, o, -w) for n, r, o, w in top), key=repr)
    assert {r[0]: (r[1], r[2]) for r in graph.nodes(edges).collect()} == {
        n: (sum(a == n for a, _, _ in both), sum(w for a, _, w in both if a == n)) for n in {a for a, _, _ in both}
    }


# --- balance


def test_balance_takes_exactly_k(spark, scratch):
    rows = [(k, f"s{k % 3}") for k in range(300)] + [(7, "hot")] * 500 + [(k, "hot") for k in range(3)] + [(None, None)] * 30 + [(1, "few")] * 4
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, source string, head string").repartition(5)
    got = sampling.balance(df, "source", "doc_id", 20, scratch)
    counts = {r[0]: r[1] for r in got.groupBy("source").count().collect()}
    assert counts == {"s0": 20, "s1": 20, "s2": 20, "hot": 20, None: 20, "few": 4} and got.columns == df.columns
    marks = {r[0]: r[1] for r in df.select("doc_id", sampling.mark(F.col("doc_id"))).distinct().collect()}
    for s in ("s0", "hot"):
        ids = sorted((marks[i] for i, g in rows if g == s))[:20]
        assert sorted(marks[r[0]] for r in got.where(F.col("source") == s).collect()) == ids
    assert sampling.balance(df.limit(0), "source", "doc_id", 20, scratch).collect() == []


# --- integrity, drift, sources


def test_rules_and_quarantine(spark, scratch):
    rows = [(1, "ok", "en", 2), (1, " \n", "en", 2), (None, None, None, None), (2, "a\x00b", "xx", 9), (3, "bad �", "en", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    summary, broken = integrity.checked(df, integrity.document_rules(["en"]), scratch)
    assert {r[0]: (r[1], r[2]) for r in summary.collect()} == {
        "no_id": (5, 1), "no_text": (5, 1), "blank_text": (5, 1), "wrong_length": (5, 1), "unknown_language": (5, 2), "control_signs": (5, 1), "replaced_signs": (5, 1),
    }
    assert rows_of(broken.select("doc_id", F.concat_ws(",", "reasons"))) == sorted(
        [(1, "blank_text"), (None, "no_id,no_text,unknown_language"), (2, "wrong_length,unknown_language,control_signs"), (3, "replaced_signs")], key=repr
    )
    assert integrity.repeated_keys(df, "doc_id", "r").collect() == [("r", 5, 2)]
    labels = spark.createDataFrame([(1,), (9,), (9,), (None,)], "doc_id long")
    assert integrity.orphans(labels, "doc_id", df, "o").collect() == [("o", 4, 3)]
    assert integrity.orphans(labels.limit(0), "doc_id", df, "o").collect() == [("o", 0, 0)]


def test_sketches_merge_and_hold_their_error(spark):
    events = spark.range(200_000).select(
        F.lit("k").alias("kind"), (F.xxhash64("id") % 100_000 / 7).alias("x"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts")
    )
    weekly = drift.weekly_sketches(drift.values(events, "kind", "x", "ts"))
    whole = drift.merged(weekly, "group").select("n", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))))
    row = whole.first()
    assert row["n"] == 200_000 and weekly.count() > 2
    for q, x in zip((0.1, 0.5, 0.9), row[1:], strict=True):
        assert abs(events.where(F.col("x") <= x).count() / 200_000 - q) < 0.003


def test_drift_of_groups(spark, scratch):
    rows = [("a", float(i % 10), f"2024-01-0{1 + i % 7} 10:00:00") for i in range(100)] + [("a", 9.0, "2024-01-09 00:00:00")] * 50
    rows += [(None, 1.0, "2024-01-01 00:00:00"), ("a", None, "2024-01-01 00:00:00"), ("a", float("nan"), "2024-01-01 00:00:00"), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "kind string, x double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r[0], str(r[1])): (r[2], r[3]) for r in drift.drift_psi(df, "kind", "x", "ts", scratch).collect()}
    assert got["a", "2024-01-01"] == (100, 0.0) and got["a", "2024-01-08"][1] > 1 and got[None, "2024-01-01"] == (1, 0.0) and len(got) == 3


def test_sources_join_by_trust(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, None), (None, "q", 1), (3, "b", 2), (3, "a", 9)], "k long, name string, size int")
    b = spark.createDataFrame([(1, "y", 5, "z"), (4, None, None, None), (None, None, 7, None)], "k long, name string, size int, more string")
    got = rows_of(across.cross_source_join({"a": a, "b": b}, "k", ["name", "size", "more"]))
    assert got == sorted([
        (1, "x", "a", 5, "b", "z", "b", 2), (2, None, None, None, None, None, None, 1), (3, "a", "a", 2, "a", None, None, 1),
        (4, None, None, None, None, None, None, 1), (None, "q", "a", 1, "a", None, None, 1), (None, None, None, 7, "b", None, None, 1),
    ], key=repr)
    assert across.cross_source_merge({"a": a, "b": b}).count() == 8


# --- monitoring


def test_stream_with_late_rows(spark, scratch):
    from pagemill.streaming.monitor import Monitor, daily

    made = lambda rows: spark.createDataFrame(rows, "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    watch, landed = Monitor(spark, f"{scratch.root}/m"), f"{scratch.root}/landed"
    assert watch.days().collect() == []
    first = [("2024-01-01 10:00:00", "a", 1.25), ("2024-01-01 11:00:00", "a", None), ("2024-01-05 00:00:00", "b", 2.0), (None, "a", 1.0)]
    made(first).write.parquet(landed)
    assert watch.take(landed, made(first).schema) == 0
    # The newest event was on the 5th: with a day's delay the 3rd is closed, the 4th is not.
    second = [("2024-01-03 23:00:00", "a", 5.0), ("2024-01-04 01:00:00", "a", 3.0), ("2024-01-05 09:00:00", "b", 1.0)]
    made(second).write.mode("append").parquet(landed)
    late = watch.take(landed, made(first).schema)
    assert late == 1
    in_time = [r for r in first + second if r[0] != "2024-01-03 23:00:00"]
    assert rows_of(watch.days()) == rows_of(daily(made(in_time)))
    assert watch.take(landed, made(first).schema) == 0 and rows_of(watch.days()) == rows_of(daily(made(in_time)))
