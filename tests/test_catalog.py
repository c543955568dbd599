import random
from collections import Counter, defaultdict

import pytest

from pagemill.operators import catalog as C
from pagemill.schemas import CATALOG


def make(spark, n, batch, seed, keys=40, hot=0.33):
    """Rows of which a third share one protocol and a tenth have none."""
    rng, out = random.Random(seed), []
    for i in range(n):
        draw = rng.random()
        protocol = "hot" if draw < hot else None if draw < hot + 0.1 else f"P{rng.randrange(keys)}"
        out.append((rng.randrange(1, 12), i, f"d{seed}-{i}", None, "co", protocol, "01/01/2020", batch, i % 7))
    return spark.createDataFrame(out, CATALOG).repartition(5), out


def seq(row):
    return (row[7], row[0], row[1], row[8])


def last_rows(rows, order):
    best = {}
    for row in rows:
        if row[5] not in best or order(best[row[5]]) < order(row):
            best[row[5]] = row
    return sorted(best.values(), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keep_last_with_null_and_hot_protocols(spark):
    df, rows = make(spark, 2000, 0, 1)
    kept = collected(C.keep_last(df))
    assert kept == last_rows(rows, seq)
    assert sum(r[5] is None for r in kept) == 1


def test_new_rows_beat_old_ones_whatever_their_batch(spark):
    old, old_rows = make(spark, 800, 5, 2)
    new, new_rows = make(spark, 300, 1, 3)
    origin = {id(r): 0 for r in old_rows} | {id(r): 1 for r in new_rows}
    expected = last_rows(old_rows + new_rows, lambda r: (origin[id(r)], *seq(r)))
    assert collected(C.consolidate(old, new, "merge")) == expected
    base = C.keep_last(old)
    assert collected(C.consolidate(base, new, "merge", old_is_unique=True)) == expected


def test_overwrite_and_first_run_do_not_deduplicate(spark):
    old, _ = make(spark, 50, 0, 4)
    new, new_rows = make(spark, 200, 1, 5)
    assert collected(C.consolidate(old, new, "overwrite")) == sorted(new_rows, key=repr)
    assert collected(C.consolidate(None, new, "merge")) == sorted(new_rows, key=repr)
    with pytest.raises(ValueError):
        C.consolidate(old, new, "other")


@pytest.mark.parametrize("hot_rows", [10, 100, 10**6])
def test_duplicate_members_with_salted_hot_keys(spark, hot_rows):
    df, rows = make(spark, 1500, 0, 6, keys=900)
    counts = Counter(r[5] for r in rows)
    expected = sorted((r for r in rows if counts[r[5]] > 1), key=repr)
    assert any(n == 1 for n in counts.values())
    assert collected(C.duplicate_members(df, hot_rows=hot_rows)) == expected


def test_salts_spread_a_hot_key(spark):
    from pyspark.sql import functions as F

    df, rows = make(spark, 3000, 0, 7, keys=2000)
    hot = sum(r[5] == "hot" for r in rows)
    assert hot > 900
    salted = df.where("protocol = 'hot'").groupBy(F.pmod(F.xxhash64("batch", "id", "page", "pos"), F.lit(10))).count()
    assert max(r["count"] for r in salted.collect()) < hot / 5


def test_upsert_duplicates_equal_duplicate_members(spark):
    old, _ = make(spark, 400, 0, 8, keys=300)
    new, _ = make(spark, 100, 1, 9, keys=300)
    base = C.keep_last(old)
    both = C.scan_union(base, new)
    assert collected(C.upsert_duplicates(base, new)) == collected(C.duplicate_members(both))


def test_merge_report(spark):
    df, rows = make(spark, 600, 0, 10)
    report = {r.id: r for r in C.merge_report(df, C.keep_last(df)).collect()}
    before, nulls = Counter(r[0] for r in rows), Counter(r[0] for r in rows if r[5] is None)
    kept = Counter(r[0] for r in last_rows(rows, seq))
    for c in before:
        r = report[c]
        assert (r.rows_in, r.rows_kept, r.dropped, r.null_protocols) == (before[c], kept[c], before[c] - kept[c], nulls[c])


def test_latest_pages_replaces_whole_pages(spark):
    def row(page, batch, pos, name):
        return (1, page, name, None, "co", name, None, batch, pos)

    rows = [row(1, 0, 0, "a"), row(1, 0, 1, "gone"), row(1, 2, 0, "b"), row(2, 0, 0, "c"), row(2, 0, 1, "d")]
    kept = C.latest_pages(spark.createDataFrame(rows, CATALOG), ["batch"])
    assert sorted(r.drug for r in kept.collect()) == ["b", "c", "d"]


def test_without_category(spark):
    df, rows = make(spark, 100, 0, 11)
    left = Counter(r.id for r in C.without_category(df, 3).collect())
    expected = defaultdict(int, Counter(r[0] for r in rows if r[0] != 3))
    assert left == expected
    assert C.without_category(df).count() == 0
