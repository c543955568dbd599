import random

import pytest

from pagemill.operators import resume as R
from pagemill.operators.chat import assemble_chat, message_table
from pagemill.schemas import METADATA, PROGRESS


def progress(spark, rows):
    return spark.createDataFrame([("20240101000000", *r) for r in rows], PROGRESS)


def test_plan_of_each_kind(spark):
    metadata = spark.createDataFrame([(c, 50, 9, 400) for c in (1, 2, 3, 4)] + [(5, 50, 0, 0)], METADATA)
    log = progress(
        spark,
        [(1, 9, 9, 13), (2, 4, 9, 50), (3, 4, 9, 25), (3, 3, 9, 50), (7, 1, 9, 50)],
    )
    last = R.last_progress(log)
    plan = {r.id: (r.action, r.start_page) for r in R.resume_plan(metadata, last).collect()}
    # The short last page of 1 is no reason to restart; 5 has no rows but is eligible.
    assert plan == {1: ("skip", None), 2: ("resume", 5), 3: ("restart", 1), 4: ("fresh", 1), 5: ("fresh", 1)}
    forced = {r.id: (r.action, r.start_page) for r in R.resume_plan(metadata, last, force=True).collect()}
    assert forced == {c: ("restart", 1) for c in (1, 2, 3, 4, 5)}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_missing_pages(spark, block):
    rng = random.Random(block)
    last = {1: 40, 2: 1, 3: 7, 4: 0, 5: 9}
    saved = [(c, p) for c in (1, 2, 3) for p in range(1, last[c] + 1) if rng.random() < 0.6] + [(1, 99), (9, 1)]
    metadata = spark.createDataFrame([(c, 50, n, 0) for c, n in last.items()], METADATA)
    rows = spark.createDataFrame(saved * 3, "id int, page int")
    found = sorted(tuple(r) for r in R.missing_pages(metadata, rows, block).collect())
    assert found == sorted((c, p) for c, n in last.items() for p in range(1, n + 1) if (c, p) not in set(saved))


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_stalled_pages_across_blocks(spark, block):
    rng = random.Random(3)
    log = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(1, 4), i) for i in range(300)]
    before, expected = {}, []
    for c, page, i in log:
        if before.get(c) == page:
            expected.append((c, page, i))
        before[c] = page
    df = spark.createDataFrame(log, "category_id int, current_page int, seq bigint").repartition(4)
    found = sorted((tuple(r) for r in R.stalled_pages(df, block=block).collect()), key=lambda r: r[2])
    assert found == expected


def test_prefix_ends_at_the_first_empty_page(spark):
    counts = [(1, 1, 3), (1, 2, 0), (1, 3, 2), (1, 4, 0), (2, 1, 1), (2, 2, 1), (3, 1, 0)]
    df = spark.createDataFrame(counts, "id int, page int, n bigint")
    assert sorted(tuple(r) for r in R.contiguous_prefix(df).collect()) == [(1, 1, 3), (2, 1, 1), (2, 2, 1)]


def test_a_conversation_is_one_row_with_every_message(spark):
    import json

    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"é\n{c}-{t}") for c, n in ((1, 150), (2, 1)) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    rows = sorted(assemble_chat(df).collect(), key=lambda r: r.conv_id)
    assert [r.n_messages for r in rows] == [150, 1]
    joined = [(r.conv_id, m["role"], m["content"]) for r in rows for m in json.loads(r.messages)]
    assert joined == [(c, role, text) for c, t, role, text in turns]
    listed = message_table(df).orderBy("conv_id", "turn").collect()
    assert [json.loads(r.message) for r in listed] == [{"role": role, "content": text} for _, _, role, text in turns]


def test_missing_content_is_null_in_json(spark):
    df = spark.createDataFrame([(1, 0, "u", None)], "conv_id bigint, turn bigint, role string, text string")
    assert assemble_chat(df).first().messages == '[{"role":"u","content":null}]'


def test_prefix_of_any_category(spark):
    rows = [(i, p, n) for i in (1, 13, None) for p, n in ((1, 5), (2, 0), (3, 5))]
    df = spark.createDataFrame(rows, "id int, page int, n bigint")
    assert {tuple(r) for r in R.contiguous_prefix(df).collect()} == {(1, 1, 5), (13, 1, 5), (None, 1, 5)}


def test_log_entries_without_key_or_position_stay(spark):
    rows = [(1, 10, 5), (None, 11, 5), (None, 12, 5), (1, None, 5)]
    df = spark.createDataFrame(rows, "category_id int, seq bigint, current_page int")
    assert R.previous_in_log(df, "category_id", "seq", "current_page").count() == 4
    assert [tuple(r) for r in R.stalled_pages(df).where("category_id is null").collect()] == [(None, 12, 5)]


def test_no_category_is_gathered_to_be_cut(spark):
    """A third of the rows may be of one category: they stay in the tasks that read them, whatever the sizes."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 30_000, 1, 6).selectExpr("cast(if(id % 3 = 0, 1, 2 + id % 9) as int) id", "cast(id as int) page")
    stops = rows.where("page % 5000 = 4999").groupBy(F.col("id").alias("stop_id")).agg(F.min("page").alias("stop"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = R.before_stop(rows, stops)
        of_task = cut.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    least = {r.stop_id: r.stop for r in stops.collect()}
    want = sum(r.page < least.get(r.id, 1 << 30) for r in rows.collect())
    assert sum(r["count"] for r in of_task) == want and len(of_task) == 6
