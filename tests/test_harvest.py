import os
import uuid

import pytest

from pagemill.operators import resume
from pagemill.plans import harvest
from pagemill.schemas import CATALOG, LISTING_PAGES, METADATA
from pagemill.sources import chunks, landing, progress, snapshots
from pagemill.sources.catalog_store import CatalogStore
from pagemill.streaming.ingest import ingest_pages, stream_upsert
from tests import pages as P


@pytest.fixture
def space(tmp_path):
    return harvest.Workspace(str(tmp_path / "space"))


@pytest.fixture
def landing_dir(tmp_path):
    return str(tmp_path / "landing")


def land(spark, path, pages):
    spark.createDataFrame(pages, LISTING_PAGES).repartition(3).write.mode("append").parquet(path)


def drugs(spark, space):
    rows = CatalogStore(spark, space.root).read()
    return [] if rows is None else sorted(r.drug for r in rows.collect())


def names(category, counts, tag=""):
    return [r[0] for i, n in enumerate(counts) for r in P.rows_for(category, i + 1, n, tag)]


def log(spark, space):
    rows = progress.read_progress(spark, space.progress).collect()
    return sorted((r.category_id, r.current_page, r.last_page, r.saved_size) for r in rows)


def test_whole_run_and_check(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [2, 2, 1]) + P.category(2, [2, 2]))
    assert harvest.run(spark, landing_dir, space.root) is None
    assert drugs(spark, space) == sorted(names(1, [2, 2, 1]) + names(2, [2, 2]))
    assert log(spark, space) == [(1, 1, 3, 2), (1, 2, 3, 2), (1, 3, 3, 1), (2, 1, 2, 2), (2, 2, 2, 2)]
    (row,) = harvest.run(spark, landing_dir, space.root, check_only=True).collect()
    assert (row.expected, row.found, row.status) == (9, 9, "complete")
    assert chunks.scan_chunks(spark, space.chunks) is None
    csv = os.listdir(f"{space.root}/categories_csv")
    assert len(csv) == 1


def test_crawl_only_and_no_metadata(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [2]))
    harvest.run(spark, landing_dir, space.root, skip_crawl=True)
    assert drugs(spark, space) == []  # no metadata, so no category is worked on
    harvest.run(spark, landing_dir, space.root, crawl_only=True)
    assert drugs(spark, space) == []
    assert harvest.read_crawled(spark, space).count() == 12
    assert harvest.read_crawled(spark, space, 1).first()["size"] == 2
    assert harvest.read_crawled(spark, space, 99) is None
    (row,) = harvest.check(spark, space).collect()
    assert row.status == "no_local"


def test_a_finished_category_is_skipped_until_forced(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [2, 1]))
    harvest.run(spark, landing_dir, space.root)
    land(spark, landing_dir, P.category(1, [2, 1], batch=1, tag="new"))
    harvest.run(spark, landing_dir, space.root)
    assert drugs(spark, space) == sorted(names(1, [2, 1]))
    harvest.run(spark, landing_dir, space.root, force=True)
    assert drugs(spark, space) == sorted(names(1, [2, 1], "new"))
    assert log(spark, space) == [(1, 1, 2, 2), (1, 2, 2, 1)]
    assert len(snapshots.complete_runs(spark, f"{space.root}/categories")) == 2


def test_resume_reads_only_what_is_left(spark, space, landing_dir):
    pages = P.category(1, [2, 2, 2, 1])
    land(spark, landing_dir, pages[:2] + pages[3:])
    harvest.crawl(spark, landing_dir, space)
    harvest.save_pages(spark, landing_dir, space, [(1, 1)], "1")
    # Page 3 is missing from the load; the log says page 4 came last.
    metadata = harvest.read_crawled(spark, space)
    stored = chunks.page_summary(chunks.scan_chunks(spark, space.chunks))
    assert [tuple(r) for r in resume.missing_pages(metadata, stored).collect()] == [(1, 3)]


def test_resume_after_an_interrupted_harvest(spark, space, landing_dir):
    pages = P.category(1, [2, 2, 2, 1])
    land(spark, landing_dir, pages)
    harvest.crawl(spark, landing_dir, space)
    half = landing_dir + "-half"
    land(spark, half, pages[:2])
    harvest.save_pages(spark, half, space, [(1, 1)], "1")  # and the job dies here
    (plan,) = [r for r in harvest.plan(spark, space).collect() if r.id == 1]
    assert (plan.action, plan.start_page) == ("resume", 3)
    harvest.scrape(spark, landing_dir, space)
    assert drugs(spark, space) == sorted(names(1, [2, 2, 2, 1]))


def test_another_page_size_restarts_the_category(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [3, 3, 1], batch=1, items=3, tag="n") + P.category(2, [2, 1]))
    harvest.crawl(spark, landing_dir, space)
    old = landing_dir + "-old"
    land(spark, old, P.category(1, [2, 2, 2, 1])[:2] + P.category(2, [2, 1])[:1])
    harvest.save_pages(spark, old, space, [(1, 1), (2, 1)], "1")
    plan = {r.id: r.action for r in harvest.plan(spark, space).collect()}
    assert plan[1] == "restart"
    harvest.scrape(spark, landing_dir, space)
    rows = [d for d in drugs(spark, space) if d.startswith("D1")]
    assert rows == sorted(names(1, [3, 3, 1], "n"))


def test_the_first_empty_page_stops_a_category(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [2, 0, 2, 1]) + P.category(2, [2, 2]))
    harvest.run(spark, landing_dir, space.root)
    assert drugs(spark, space) == sorted(names(1, [2]) + names(2, [2, 2]))
    assert [e for e in log(spark, space) if e[0] == 1] == [(1, 1, 4, 2)]


def test_copies_and_older_landings_of_a_page_count_once(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [2, 1]) * 5 + P.category(1, [1, 1], batch=2, tag="v2")[:1])
    harvest.run(spark, landing_dir, space.root)
    assert drugs(spark, space) == sorted(names(1, [1], "v2") + [P.rows_for(1, 2, 1)[0][0]])


def test_merge_keeps_the_new_row_and_reports_duplicates(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [2, 1]))
    harvest.run(spark, landing_dir, space.root)
    later = landing_dir + "-later"
    land(spark, later, P.category(1, [2], batch=1, tag="new"))
    store = CatalogStore(spark, space.root)
    assert not store.is_unique()
    for _ in range(2):  # the second time the catalog is unique already
        harvest.save_pages(spark, later, space, [(1, 1)], uuid.uuid4().hex)
        harvest.consolidate_chunks(spark, space)
        assert drugs(spark, space) == sorted(names(1, [2], "new") + [P.rows_for(1, 2, 1)[0][0]])
        assert store.is_unique()
        report = snapshots.read_latest(spark, store.duplicates, CATALOG)
        assert report.count() == 4


def test_a_failed_merge_fails_the_job_and_keeps_the_chunks(spark, space, landing_dir, monkeypatch):
    land(spark, landing_dir, P.category(1, [2]))
    harvest.crawl(spark, landing_dir, space)

    def broken(*args):
        raise RuntimeError("disk")

    monkeypatch.setattr(CatalogStore, "write", broken)
    with pytest.raises(RuntimeError):
        harvest.scrape(spark, landing_dir, space)
    assert chunks.scan_chunks(spark, space.chunks).count() == 2


def test_an_incomplete_run_is_not_read(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2, 3, 4)], METADATA)
    snapshots.write_run(rows, table, "1")
    snapshots.write_run(rows.where("false"), table, "2")
    os.remove(f"{table}/run=2/_SUCCESS")
    assert snapshots.latest_run(spark, table) == "1"
    assert snapshots.read_latest(spark, table, METADATA).count() == 1
    assert snapshots.read_latest(spark, str(tmp_path / "none"), METADATA) is None


def test_a_load_written_again_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    pages = spark.createDataFrame(P.category(1, [2]) + P.category(2, [1]), LISTING_PAGES)
    from pagemill.operators.extract import extract_chunk_rows

    for _ in range(2):
        chunks.write_chunks(extract_chunk_rows(pages), root, "a")
    assert chunks.scan_chunks(spark, root).count() == 3
    assert chunks.delete_chunks(spark, root, 2) == 1
    assert [r.id for r in chunks.scan_chunks(spark, root).select("id").distinct().collect()] == [1]
    chunks.delete_chunks(spark, root)
    assert chunks.scan_chunks(spark, root) is None


def test_csv_keeps_empty_and_missing_apart(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    rows = [(1, 1, 'a "q", b', "", None, "p", None, 0, 0), (1, 1, "line\nbreak", None, "c", None, "d", 0, 1)]
    store.write(spark.createDataFrame(rows, CATALOG), "1", unique=True)
    back = snapshots.read_latest(spark, store.csv, CATALOG[:7], "csv")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted((r[:7] for r in rows), key=repr)


def test_stream_equals_batch(spark, space, landing_dir, tmp_path):
    first = P.category(1, [2, 2, 1]) + P.category(2, [2, 1])
    second = P.category(1, [2], batch=1, tag="new") + P.category(3, [1], batch=1)
    land(spark, landing_dir, first)
    assert stream_upsert(spark, landing_dir, space, files_per_batch=1) is not None
    land(spark, landing_dir, second)
    stream_upsert(spark, landing_dir, space, files_per_batch=2)
    assert stream_upsert(spark, landing_dir, space) is None  # nothing landed
    batch = harvest.Workspace(str(tmp_path / "batch"))
    for i, pages in enumerate((first, second)):
        path = f"{landing_dir}-{i}"
        land(spark, path, pages)
        harvest.save_pages(spark, path, batch, [(c, 1) for c in (1, 2, 3)], str(i))
        harvest.consolidate_chunks(spark, batch)
    expected = sorted(names(1, [2], "new") + names(1, [2, 2, 1])[2:] + names(2, [2, 1]) + names(3, [1]))
    assert drugs(spark, space) == drugs(spark, batch) == expected


def test_a_replayed_micro_batch_counts_once(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [2, 1]))
    ingest_pages(spark, landing_dir, space)
    before = chunks.scan_chunks(spark, space.chunks).count()
    pages = spark.read.schema(LISTING_PAGES).parquet(landing_dir)
    harvest.store_pages(pages, space, chunks.loads(spark, space.chunks)[0])
    assert chunks.scan_chunks(spark, space.chunks).count() == before
    assert len(log(spark, space)) == 2


def test_command_line(spark, space, landing_dir, capsys, monkeypatch):
    from pagemill import __main__ as cli

    land(spark, landing_dir, P.category(1, [2]))
    cli.main([landing_dir, space.root])
    cli.main([landing_dir, space.root, "--check"])
    assert "complete" in capsys.readouterr().out


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_repeated_pages_joined_or_broadcast(spark, space, landing_dir, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        land(spark, landing_dir, P.category(1, [2, 2, 1]) + P.category(1, [1, 1], batch=3, tag="v2") * 9)
        harvest.store_pages(landing.read_pages(spark, landing_dir), space, "1")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = chunks.scan_chunks(spark, space.chunks).collect()
    assert sorted((r.page, r.batch) for r in stored) == [(1, 3), (2, 3), (3, 0)]
    assert all(("v2" in r.drug) == (r.batch == 3) for r in stored)


def test_the_later_landing_wins_within_a_batch(spark, space, landing_dir):
    for tag in ("z", "a", "m"):
        land(spark, landing_dir, P.category(1, [1], tag=tag))
        harvest.store_pages(landing.read_pages(spark, landing_dir), space, "1")
        assert [r.drug for r in chunks.scan_chunks(spark, space.chunks).collect()] == names(1, [1], tag)


def test_page_versions_without_batch_are_replaced(spark, space):
    pages = [(i, p, None, html) for i, p, _, html in P.category(1, [2, 1])]
    for load in ("1", "2"):
        harvest.store_pages(spark.createDataFrame(pages, LISTING_PAGES), space, load)
    harvest.consolidate_chunks(spark, space)
    assert drugs(spark, space) == sorted(names(1, [2, 1]))


def test_page_texts_are_never_shuffled(spark, space, landing_dir):
    from tests.test_plans import plan

    land(spark, landing_dir, P.category(1, [2, 1]) * 5)
    pages = landing.read_pages(spark, landing_dir)
    replaced = landing.replaced_landings(pages)
    assert "html" not in plan(replaced)
    staged = snapshots.staged(replaced, f"{space.staged}/replaced", "1")
    text = plan(harvest.without_versions(harvest.extract_chunk_rows(pages), staged, ["at"]))
    assert not any("Exchange" in line and "html" in line for line in text.splitlines())


def test_a_load_that_arrives_during_a_merge_stays(spark, space, monkeypatch):
    harvest.store_pages(spark.createDataFrame(P.category(1, [2]), LISTING_PAGES), space, "a")
    merge = CatalogStore.merge

    def meanwhile(store, *args):
        merge(store, *args)
        harvest.store_pages(spark.createDataFrame(P.category(2, [1]), LISTING_PAGES), space, "b")

    monkeypatch.setattr(CatalogStore, "merge", meanwhile)
    harvest.consolidate_chunks(spark, space)
    assert chunks.loads(spark, space.chunks) == ["b"]
    monkeypatch.setattr(CatalogStore, "merge", merge)
    harvest.consolidate_chunks(spark, space)
    assert drugs(spark, space) == sorted(names(1, [2]) + names(2, [1]))


def test_a_crash_before_the_drop_changes_nothing(spark, space, monkeypatch):
    rows = P.category(1, [2, 2]) + P.category(2, [2])
    harvest.store_pages(spark.createDataFrame(rows, LISTING_PAGES), space, "1")
    drop = chunks.delete_loads
    monkeypatch.setattr(chunks, "delete_loads", lambda s, root, names: drop(s, root, names) if not names else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        harvest.consolidate_chunks(spark, space)
    monkeypatch.setattr(chunks, "delete_loads", drop)
    before = drugs(spark, space)
    assert harvest.consolidate_chunks(spark, space) is None
    assert drugs(spark, space) == before and chunks.loads(spark, space.chunks) == []
    assert snapshots.read_latest(spark, CatalogStore(spark, space.root).duplicates, CATALOG) is None


def test_chunks_of_several_loads(spark, tmp_path):
    space = harvest.Workspace(str(tmp_path / "space"))
    for load, pages in (("1", P.category(1, [2, 2])), ("2", P.category(1, [1, 0], batch=1, tag="v2"))):
        harvest.store_pages(spark.createDataFrame(pages, LISTING_PAGES), space, load)
    harvest.consolidate_chunks(spark, space)
    # The second page is empty in its newest form, so the category ends before it.
    assert drugs(spark, space) == names(1, [1], "v2")


def test_check_of_one_category(spark, space, landing_dir):
    land(spark, landing_dir, P.category(1, [2, 1]) + P.category(2, [2, 0]))
    harvest.run(spark, landing_dir, space.root)

    def status(category_id):
        (row,) = harvest.check(spark, space, category_id).collect()
        return row.expected, row.found, row.status

    assert status(1) == (3, 3, "complete")
    assert status(2) == (2, 2, "complete")
    assert status(12) == (0, 0, "complete")
    assert status(99) == (None, 0, "no_metadata")
    assert status(None) == (5, 5, "complete")


def test_scratch_tables_go_to_the_shared_folder(spark):
    from pagemill.sources import storage

    first, second = storage.shared_dir(spark), storage.shared_dir(spark)
    assert first.startswith(spark.conf.get("spark.checkpoint.dir")) and first != second


def test_csv_twin_after_a_crash(spark, space, landing_dir, monkeypatch):
    """The job dies between the parquet run and its twin; the next one writes the twin and merges nothing again."""
    land(spark, landing_dir, P.category(1, [2, 1]))
    write = snapshots.write_run

    def dies(rows, table, run, file_format="parquet"):
        if table.endswith("categories_csv"):
            raise RuntimeError("lost")
        write(rows, table, run, file_format)

    monkeypatch.setattr(snapshots, "write_run", dies)
    with pytest.raises(RuntimeError, match="lost"):
        harvest.run(spark, landing_dir, space.root)
    monkeypatch.setattr(snapshots, "write_run", write)
    assert not os.path.exists(f"{space.root}/categories_csv") or not os.listdir(f"{space.root}/categories_csv")
    harvest.run(spark, landing_dir, space.root)
    store = CatalogStore(spark, space.root)
    run = snapshots.latest_run(spark, store.parquet)
    assert snapshots.complete_runs(spark, store.csv) == [run]
    twin = snapshots.read_latest(spark, store.csv, CATALOG, "csv")
    assert sorted(r.drug for r in twin.collect()) == drugs(spark, space) == sorted(names(1, [2, 1]))
    assert not os.path.exists(store.csv_due)


def test_plan_reads_last_entries(spark, space, landing_dir, tmp_path):
    land(spark, landing_dir, P.category(1, [2, 2]) + P.category(2, [1]))
    harvest.run(spark, landing_dir, space.root)
    land(spark, landing_dir, P.category(1, [2, 2, 2])[2:])
    harvest.run(spark, landing_dir, space.root)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(resume.last_progress(progress.read_progress(spark, space.progress)))
    kept = f"{space.progress}/last/epoch=0"
    assert rows(progress.read_last(spark, space.progress)) == want and len(want) == 2
    assert sum(spark.read.parquet(f"{kept}/{n}").count() for n in os.listdir(kept)) <= 2 * len(os.listdir(kept))
    # A load that was logged only.
    os.remove(f"{kept}/{sorted(os.listdir(kept))[-1]}/_SUCCESS")
    assert rows(progress.read_last(spark, space.progress)) == want
    assert progress.read_last(spark, str(tmp_path / "none")).collect() == []
