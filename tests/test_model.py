"""Random landings and runs against a plain model of the same rules."""

import random

import pytest

from pagemill.operators.reconcile import completeness_by_category
from pagemill.plans import harvest
from pagemill.schemas import LISTING_PAGES
from pagemill.sources.catalog_store import CatalogStore
from tests import pages as P

CATEGORIES = (1, 2, 3)


class Model:
    def __init__(self):
        self.pages, self.catalog, self.log = {}, None, {}

    def land(self, category, batch, counts, items, tag):
        for i, n in enumerate(counts):
            self.pages[category, i + 1] = (batch, P.rows_for(category, i + 1, n, tag), len(counts), items)

    def metadata(self):
        found = {}
        for c in range(1, 13):
            first = self.pages.get((c, 1))
            last = first and self.pages.get((c, first[2]))
            found[c] = (first[3], first[2], (first[2] - 1) * len(first[1]) + len(last[1])) if last else (0, 0, 0)
        return found

    def run(self, force):
        metadata, new = self.metadata(), []
        if force:
            self.log = {}
        for c in CATEGORIES:
            entry, start = self.log.get(c), 1
            if entry and entry[0] == entry[1]:
                continue
            if entry and entry[2] == metadata[c][0]:
                start = entry[0] + 1
            for page in sorted(p for k, p in self.pages if k == c and p >= start):
                batch, rows, last, _ = self.pages[c, page]
                if not rows:
                    break
                self.log[c] = (page, last, len(rows))
                new += [(batch, c, page, k, row) for k, row in enumerate(rows)]
        if not new:
            return
        if force or self.catalog is None:
            self.catalog = new
            return
        kept = {}
        for row in [*sorted(self.catalog, key=lambda r: r[:4]), *sorted(new, key=lambda r: r[:4])]:
            kept[row[4][3]] = row
        self.catalog = list(kept.values())


@pytest.mark.parametrize("seed", range(2))
def test_runs_follow_the_model(spark, tmp_path, seed):
    rng, model, space = random.Random(seed), Model(), harvest.Workspace(str(tmp_path / "space"))
    path = str(tmp_path / "landing")
    for batch in range(3):
        landed = []
        for c in CATEGORIES:
            items = rng.choice([2, 2, 3])
            counts = [items] * rng.randrange(0, 4) + [rng.randrange(0, items + 1)]
            if rng.random() < 0.3:
                counts.insert(rng.randrange(len(counts) + 1), 0)
            if batch and rng.random() < 0.4:
                continue
            tag = f"v{batch}"
            model.land(c, batch, counts, items, tag)
            landed += P.category(c, counts, batch, items, tag) * rng.choice([1, 1, 3])
        if landed:
            spark.createDataFrame(landed, LISTING_PAGES).repartition(3).write.mode("append").parquet(path)
        force = batch > 0 and rng.random() < 0.5
        harvest.run(spark, path, space.root, force=force)
        model.run(force)
        rows = CatalogStore(spark, space.root).read()
        found = [] if rows is None else sorted((r.batch, r.id, r.page, r.pos, r.drug, r.protocol) for r in rows.collect())
        assert found == sorted((b, c, p, k, row[0], row[3]) for b, c, p, k, row in model.catalog or [])
        crawled = {r.id: (r.items_page, r.last_page, r.size) for r in harvest.read_crawled(spark, space).collect()}
        assert crawled == model.metadata()
        if rows is not None:
            status = {r.id: r.diff for r in completeness_by_category(rows, harvest.read_crawled(spark, space)).collect()}
            local = {c: sum(r[1] == c for r in model.catalog) for c in crawled}
            assert status == {c: crawled[c][2] - local[c] for c in crawled}
