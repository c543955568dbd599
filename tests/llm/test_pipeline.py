"""The pipeline's stages, the queries against their SQL, and the guard of the driver's entry."""

import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, rows_of
from pagemill.llm.common import Scratch, table
from pagemill.llm.extendible_shards import Limits
from pagemill.llm import extendible_shards, oracles, queries
from tests.llm.conftest import DOCUMENTS, SMALL, WORD
from tests.llm.test_pairs import least_reachable, passages_by_force, shingles

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiny():
    return connect(TINY)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, tiny, name):
    result = tiny.execute(oracles.ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    df = queries.QUERIES[name](spark, TINY)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs and theirs


def test_shards_equal_sql_where_many_split(spark, tiny):
    result = tiny.execute(oracles.shards(Limits(30_000)))
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    df = extendible_shards.shards(table(spark, TINY, "documents"), Limits(30_000))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs


def test_every_operator_has_a_query():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14)) and len(corpus_pipeline.STAGES) == 5


def test_stages_by_force(spark):
    """Each stage on what the one before it kept, against plain versions of its rule."""
    docs, scratch, before = table(spark, SMALL, "documents"), Scratch(spark), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.save(stage(spark, docs, SMALL), f"stage-{k}")
        if k < 4:
            assert out.columns == docs.columns
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        after = sorted((r.doc_id, r.text) for r in out.collect()) if k < 4 else None
        if name == "quality classifier":
            known = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
            gone = {i for i, _ in before} - {i for i, _ in after}
            judged = [(i in gone) == (known[i] == 0) for i, _ in before if i in known]
            assert sum(judged) / len(judged) > 0.97 and set(after) <= set(before)
        elif name == "n-gram Jaccard join":
            sets = {i: shingles(t) for i, t in before}
            lists = {}
            for i, s in sets.items():
                for x in s:
                    lists.setdefault(x, []).append(i)
            pairs = Counter((a, b) for v in lists.values() for a in v for b in v if a < b)
            links = [(a, b) for (a, b), c in pairs.items() if 100 * c >= 80 * len(sets[a] | sets[b])]
            root = least_reachable(sets, links)
            assert after == [(i, t) for i, t in before if root[i] == i] and len(after) < len(before)
        elif name == "suffix-array dedup":
            _, later = passages_by_force(before, 50)
            for (i, old), (j, new) in zip(before, after, strict=True):
                words = WORD.findall(old)
                assert i == j and WORD.findall(new) == [w for n, w in enumerate(words) if n not in later.get(i, ())]
        elif name == "mixing":
            assert set(after) == set(before) and len(after) > len(before)
        else:
            assert out.where("not round_trip").isEmpty() and out.count() == docs.count()
        docs = out


def test_stages_on_edges(spark, edges):
    """The rows of each stage, on missing, blank, repeated and very long texts and a missing id."""
    columns = [c.split()[0] for c in DOCUMENTS.split(", ")]
    docs, scratch, ids = edges.select(*columns), Scratch(spark), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.save(stage(spark, docs, TINY), f"stage-{k}")
        ids.append(sorted(((r.doc_id is None, r.doc_id) for r in docs.select("doc_id").collect())))
        if k < 4:
            assert docs.columns == columns and docs.schema == before.schema
    assert set(ids[0]) <= {(r.doc_id is None, r.doc_id) for r in edges.collect()}
    worded = [r for r in edges.collect() if (r.doc_id is None, r.doc_id) in ids[0]]
    groups = {}
    for r in worded:  # exact copies: the rest is tested by force on the whole table
        groups.setdefault(tuple(sorted(shingles(r.text))) or id(r), []).append((r.doc_id is None, r.doc_id))
    assert len(ids[1]) <= len(groups) and all(min(g) in ids[1] for g in groups.values() if (False, 8) not in g and (False, 17) not in g)
    assert ids[2] == ids[1]  # nothing is cut to nothing here
    assert set(ids[3]) == set(ids[2]) and ids[4] == ids[3]


def test_stages_on_nothing(spark, nothing):
    docs, scratch = nothing, Scratch(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.save(stage(spark, docs, TINY), f"stage-{k}")
        assert docs.count() == 0
    assert docs.columns[0] == "doc_id"


def test_near_duplicates_keep_one_row_of_each(spark, edges):
    kept = corpus_pipeline.near_duplicates(spark, edges, TINY)
    assert kept.columns == edges.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # Without an id, the copy of document 6 goes and the row without a text stays.
    assert all(n == 1 for n in ids.values()) and None in ids
    assert 13 not in ids and 6 in ids and {0, 1, 2, 3, 10, 14}.issubset(ids)


def test_near_duplicates_lose_no_namesake(spark):
    a, b, c, d = (f"{x} words of {x} text that {x} ten words {x}" for x in ("first", "second", "third", "fourth"))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, c, "x"), (3, c, "x"), (None, c, "x"), (None, d, "x"), (None, d, "y"), (4, None, "x"), (4, None, "x")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), TINY)
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert got == sorted([(1, a, "x"), (1, b, "x"), (3, c, "x"), (None, d, "x"), (4, None, "x"), (4, None, "x")], key=repr)


def test_queries_see_whole_tables(spark):
    n = table(spark, TINY, "documents").count()
    for name in ("op2_sentencepiece", "op6_quality_classifier", "op7_token_frames", "op8_mixing"):
        assert queries.QUERIES[name](spark, TINY).agg(F.count("*")).first()[0] == n


def test_entry_works_without_the_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("pagemill.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
assert not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"] and len(entry.queries()) > 40
"""
    home = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=home)
