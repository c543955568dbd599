"""Exact search, phrases and runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bytewords as bw
from pagemill.llm import periodic_runs, phrase_mining, queries, segment_search
from pagemill.llm.common import Scratch
from tests.llm.conftest import CLASHING, WORD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- 11: search


def best_by_force(rows, k=5, every=50):
    def whole(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    points = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if whole(v)]
    out = []
    for a, (i, v) in enumerate(points):
        if i is None or i % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0) for b, (j, w) in enumerate(points) if a != b)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def best_of(spark, rows, every=50, **kw):
    df = spark.createDataFrame([(*r, 1, "z", "z") for r in rows], "vec_id long, embedding array<float>, label int, score string, q string").repartition(3)
    return sorted((tuple(r) for r in segment_search.nearest(df, F.col("vec_id") % every == 0, **kw).collect()), key=repr)


def test_search_on_edges(spark):
    a = [0.5, -0.25, 1.0]
    rows = [
        (0, a), (1, a), (2, [1.0, -0.5, 2.0]), (50, a), (50, a), (50, [0.1, 0.2, 0.3]), (100, None), (150, [0.0, None, 1.0]), (3, [float("nan"), 1.0, 1.0]),
        (200, [float("inf"), 0.0, 0.0]), (None, a), (None, a), (250, [1.0, 2.0]), (300, []), (-50, [-0.001, 0.001, 0.0]), (4, [1e6, 1.0, -1e6]), (5, [3.0] * 7),
    ]
    assert best_of(spark, rows) == best_by_force(rows)
    assert best_of(spark, []) == [] and best_of(spark, [(0, a)]) == []
    with pytest.raises(Exception, match="beyond a long"):
        best_of(spark, [(0, [1e30]), (1, [1.0])])


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e6, 1e6, 1.0]), (1, [1e6, -1e6, 5.0]), (2, [1e6, -1e6, 6.0]), (3, [1e6, 1e6, 0.5])]
    assert best_of(spark, rows) == best_by_force(rows)


@pytest.mark.parametrize("dim", [3, 24])
def test_search_in_rounds_and_blocks(spark, monkeypatch, dim):
    """Clusters, copies of one vector, and several rounds, blocks and resolutions."""
    monkeypatch.setattr(segment_search, "ROUND_NUMBERS", 40 * dim)
    monkeypatch.setattr(segment_search, "SAMPLE_NUMBERS", 10 * dim)
    rng, rows = np.random.default_rng(dim), []
    for c in range(12):
        center = rng.normal(size=dim) + 3 * (c % 2)
        for _ in range(30):
            rows.append((len(rows), (center + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.5])).tolist()))
    rows += [(1000 + k, rows[3][1]) for k in range(60)]
    assert best_of(spark, rows, every=4) == best_by_force(rows, every=4)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    steps = np.repeat(rng.normal(size=(300, 8)) * 300, 8, axis=1) + rng.normal(size=(300, 64)) * 5
    x = np.floor(steps)
    exact = x @ x.T
    for segments in (1, 4, 16):
        own = segment_search.statistics(x, segments)
        assert (own @ own.T >= exact - 1e-6 * np.abs(exact).max()).all()
    ids, rows = np.arange(300), x.astype(np.int64)
    seen = segment_search.Round(ids, rows, segment_search.Search())
    seen.take(ids, np.ones(300, bool), np.ones(300, np.int64), rows)
    asked, _ = seen.survivors(slice(0, 300), x, [segment_search.statistics(x, s) for s in (1, 4, 16)], np.sqrt((x * x).sum(1)))
    assert len(asked) < 0.2 * 300 * 300  # smooth vectors: few pairs are multiplied out


# --- 12: phrases


def phrases_by_force(rows, longest=5, least=100, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = ("und" if lang is None else lang, tuple(w[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    often = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    inside = set()
    for (lang, w), f in often.items():
        for k in range(2, len(w)):
            inside |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if f >= counts[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) in inside:
            continue
        n = totals[lang]
        score, cut = min((1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        row = (" ".join(w), a, counts[lang, w[:cut]], counts[lang, w[cut:]], n, score)
        out.setdefault(lang, []).append(((-score, -a, row[0].encode()), row))
    return sorted((lang, r + 1, *row) for lang, rows in out.items() for r, (_, row) in enumerate(sorted(rows)[:top]))


def phrases_of(df, **kw):
    return sorted(tuple(r) for r in phrase_mining.collocations(df, phrase_mining.Mining(**kw)).collect())


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(3)
    fixed = ["new york", "Ab cd éf", "x y z w v u", "a a a a", "the", "of the", "t"]
    texts = []
    for _ in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.6 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))]
        texts.append("".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b", "  "]) for p in parts))
    rows = [(t, rng.choice(["en", "en", "de", None, "und", ""])) for t in texts]
    return rows + [(None, "en"), ("", "de"), (" .\n", "fr"), (texts[0], "en"), (texts[0], "en"), ("new york " * 3000, "en"), ("only", "xx")]


@pytest.mark.parametrize("held", [1 << 21, 3])
def test_phrases(spark, monkeypatch, phrase_rows, held):
    """Frequent phrases as an array, and as a table to join."""
    monkeypatch.setattr(phrase_mining, "HELD", held)
    extra = tuple("z" for _ in CLASHING.split(","))
    df = spark.createDataFrame([(k, *r, *extra) for k, r in enumerate(phrase_rows)], f"doc_id long, text string, lang string, {CLASHING}").repartition(4)
    assert phrases_of(df) == phrases_by_force(phrase_rows)
    if held > 3:
        assert phrases_of(df, least=20, top=3) == phrases_by_force(phrase_rows, least=20, top=3)


def test_ranking_thins_large_groups(spark, monkeypatch, phrase_rows):
    monkeypatch.setattr(phrase_mining, "RANKED", 8)
    df = spark.createDataFrame(phrase_rows, "text string, lang string")
    assert phrases_of(df, least=5, top=2) == phrases_by_force(phrase_rows, least=5, top=2)


def test_phrases_of_nothing(nothing):
    assert phrases_of(nothing) == []


def test_scores_pass_64_bits(spark):
    big = 10**9
    phrases = spark.createDataFrame([("en", "a b", 2, 10**8), ("en", "a", 1, big), ("en", "b", 1, big)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    (row,) = phrase_mining.weakest_cuts(phrases, totals, Scratch(spark)).collect()
    assert row["score"] == 1000 * 10**8 * 10**13 // big**2


# --- 13: runs


def runs_by_force(w, exponent=4, least=6):
    """Every maximal stretch, by its smallest period."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, exponent * q) and not any(all(w[x] == w[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_force(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run_texts(n):
    rng = random.Random(9)
    for _ in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            yield [rng.choice("ab") for _ in range(rng.randrange(90))]
        elif kind == 1:
            yield [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]
        else:
            w = []
            for _ in range(rng.randrange(1, 5)):
                block = [rng.choice("abcxyé") for _ in range(rng.randrange(1, 9))]
                w += (block * 40)[: rng.randrange(1, 40)] + [rng.choice("pqrst") for _ in range(rng.randrange(4))]
            yield w * (rng.randrange(1, 6) if kind == 3 else 1)


@pytest.mark.parametrize("looks", [periodic_runs.LOOKS, 50])
def test_runs_of_texts(monkeypatch, looks):
    monkeypatch.setattr(periodic_runs, "LOOKS", looks)
    texts = list(run_texts(400))
    got = []
    for chunk in bw.chunks(pa.array([" \n".join(w) for w in texts]), max_bytes=5000):
        runs, collapsed = periodic_runs.runs_of_chunk(chunk, periodic_runs.Rule())
        got += zip(runs.to_pylist(), collapsed.to_pylist(), strict=True)
    for w, (runs, collapsed) in zip(texts, got, strict=True):
        want = runs_by_force(w)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert collapsed == collapsed_by_force(w, want)


def test_a_very_long_run():
    (chunk,) = bw.chunks(pa.array(["a " * 400_000 + "b " * 5 + "c d " * 100_000]))
    runs, collapsed = periodic_runs.runs_of_chunk(chunk, periodic_runs.Rule())
    assert [tuple(r.values()) for r in runs.to_pylist()[0]] == [(0, 400_000, 1), (400_005, 200_000, 2)]
    assert collapsed.to_pylist() == ["a b b b b b c d"]


def query_by_force(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    runs = runs_by_force(w) if n < 1500 else None
    return w, runs


def test_run_query_on_edges(spark, tmp_path, edges, edge_rows):
    edges.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, text, *_ in edge_rows:
        w, runs = query_by_force(i, text)
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(lines), digest(collapsed_by_force(w, runs))))
    assert len(got) == len(edge_rows)
    long = {i for i, t, *_ in edge_rows if len(WORD.findall(t or "")) >= 1500}
    assert sorted((tuple(r) for r in got if r["doc_id"] not in long), key=repr) == sorted(want, key=repr)


def test_looped_documents_of_every_length(spark, tmp_path):
    rows = [(k, " ".join(f"w{j % 50}" for j in range(k % 70)) or None) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    looped = 0
    for i, text in rows:
        w, runs = query_by_force(i, text)
        looped += bool(runs)
        assert got[i]["n_runs"] == len(runs)
        assert got[i]["collapsed_sha256"] == hashlib.sha256(collapsed_by_force(w, runs).encode()).hexdigest()
    assert looped > 5


def test_runs_on_nothing(nothing):
    assert periodic_runs.periodic_runs(nothing).collect() == []
    assert periodic_runs.periodic_runs(nothing).columns == [*nothing.columns, "n_words", "runs", "collapsed"]
