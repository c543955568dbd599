import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagemill.operators import extract, reconcile
from pagemill.operators.extract import extract_listing_rows
from tests import pages as P

SCHEMA = "id int, page int, html string"
GOOD = "<td>{}</td><td>c</td><td>p</td><td>d</td>"


def rows(spark, *htmls):
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(htmls)], SCHEMA)
    out = extract_listing_rows(df).orderBy("page", "pos").collect()
    return [(r.page, r.drug, r.link, r.company, r.protocol, r.pub_date) for r in out]


def first(spark, drug_cell):
    html = f"<table><tr><td>#</td>{GOOD.format(drug_cell)}</tr></table>"
    (row,) = rows(spark, html)
    return row[1:3]


@pytest.mark.parametrize(
    "cell, drug, link",
    [
        ('<a href="">x</a>', "x", ""),
        ("<a href>x</a>", "x", ""),
        ("<a>x</a>", "x", None),
        ('<a>x</a><a href="second">y</a>', "xy", None),
        ("x", "x", None),
        ("A <b>B</b>", "AB", None),
        (" \n ", None, None),
        ("&nbsp;<b> </b>", None, None),
        ("a<!-- <b>no</b> -->b", "ab", None),
        ("a <!-- c --> b", "ab", None),
        ('<a title=" href=\'no\'" href="yes">x</a>', "x", "yes"),
        ('<a data-href="no" href=\'q"q\'>x</a>', "x", 'q"q'),
        ("<a href=bare>x</a>", "x", "bare"),
        ('<a class="a" href="?a=1&amp;b=2">x &amp; y</a>', "x & y", "?a=1&b=2"),
        ('<a title="a > b" href="u">x</a>', "x", "u"),
        ("&amp;lt;", "&lt;", None),
        ("1 &lt; 2", "1 < 2", None),
        ("<script>no</script>x", "x", None),
    ],
)
def test_drug_cell(spark, cell, drug, link):
    assert first(spark, cell) == (drug, link)


def test_rows_need_five_cells_and_more_are_ignored(spark):
    html = (
        "<TABLE><thead><tr><th>h</th></tr></thead><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr>"
        "<tr><td>1</td><td>a</td><td>b</td><td>c</td><td>d</td><td>e</td></tr></TABLE>"
    )
    assert rows(spark, html) == [(0, "a", None, "b", "c", "d")]
    df = spark.createDataFrame([(1, 1, html)], SCHEMA)
    assert [tuple(r) for r in extract.malformed_rows(df).collect()] == [(1, 1, 1, 4)]


def test_only_the_first_table_counts(spark):
    table = f"<table><tr><td>#</td>{GOOD.format('{}')}</tr></table>"
    html = "<!-- " + table.format("no") + " -->" + table.format("yes") + table.format("later")
    assert [r[1] for r in rows(spark, html)] == ["yes"]


def test_pages_without_a_table_give_nothing(spark):
    assert rows(spark, "<p>none</p>", "", None, "<table></table>", "<tr><td>1</td></tr>") == []


def test_an_open_table_is_read_to_the_end(spark):
    assert len(rows(spark, f"<table><tr><td>#</td>{GOOD.format('x')}</tr>")) == 1


def test_long_markup(spark):
    filler = "<b>x</b> " * 50_000
    assert first(spark, filler)[0] == "x" * 50_000


@pytest.mark.parametrize(
    "html, expected",
    [
        (P.pager(3, 9), (3, 4, 9)),
        (P.pager(9, 9), (9, 9, 9)),
        ("", (1, 1, 1)),
        ('<ul class="other"><li class="active"><a>3</a></li></ul>', (1, 1, 1)),
        (P.pager(3, 9).replace(">9<", "> … <"), (1, 1, 1)),
        (P.pager(3, 9).replace("<li><a>4</a></li>", ""), (1, 1, 1)),
        (P.pager(3, 9).replace("<a>4</a>", "4"), (1, 1, 1)),
        (P.pager(3, 9).replace(">3<", "> <span> 3 </span> <"), (3, 4, 9)),
        (P.pager(3, 9).replace(">3<", ">²<"), (1, 1, 1)),
    ],
)
def test_pagination(spark, html, expected):
    df = spark.createDataFrame([(1, 1, html)], SCHEMA)
    (row,) = extract.page_states(df).collect()
    assert (row.current, row.next, row["last"]) == expected
    assert row.items_page == 0


def test_items_page(spark):
    htmls = [P.sizes(50), P.sizes("all"), "<div class='ng-table-counts'></div>"]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(htmls)], SCHEMA)
    assert [r.items_page for r in extract.page_states(df).orderBy("page").collect()] == [50, 0, 0]


def test_crawl_metadata(spark):
    landed = (
        P.category(1, [2, 2, 1])
        + P.category(2, [2])
        + P.category(3, [2, 2])[:1]  # the last page did not land
        + P.category(4, [2, 2])[1:]  # the first page did not land
        + P.category(5, [0])
        + P.category(13, [2])  # not a known category
    )
    pages = spark.createDataFrame([(r[0], r[1], r[3]) for r in landed], SCHEMA)
    found = {r.id: tuple(r)[1:] for r in reconcile.crawl_metadata(reconcile.category_domain(spark), pages).collect()}
    assert sorted(found) == list(range(1, 13))
    assert found[1] == (2, 3, 5)
    assert found[2] == (2, 1, 2)
    assert found[5] == (2, 1, 0)
    assert {found[c] for c in (3, 4, 6, 12)} == {(0, 0, 0)}


TEXT = st.text(st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="￾￿"), max_size=12)
ROW = st.tuples(TEXT, st.one_of(st.none(), TEXT), TEXT, TEXT, TEXT)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=40))
def test_round_trip(spark, made):
    df = spark.createDataFrame([(1, 1, P.page(made))], SCHEMA)
    found = [tuple(r) for r in extract_listing_rows(df).orderBy("pos").select("drug", "link", "company", "protocol", "pub_date").collect()]

    def shown(value):
        return value.strip() or None

    assert found == [(shown(d), li, shown(c), shown(p), shown(t)) for d, li, c, p, t in made]


def test_brackets_in_attributes_before_the_class(spark):
    shown = P.pager(3, 9).replace("<ul ", '<ul ng-if="pages.length > 1" title=\'class="x"\' ').replace("<li ", '<li ng-if="a > b" ')
    df = spark.createDataFrame([(1, 1, shown + P.sizes(25).replace("<div ", '<div ng-show="x > 1" '))], SCHEMA)
    (row,) = extract.page_states(df).collect()
    assert (row.current, row.next, row["last"], row.items_page) == (3, 4, 9, 25)


def test_copies_of_a_page_do_not_change_the_metadata(spark):
    landed = P.category(1, [2, 1]) * 4
    pages = spark.createDataFrame([(r[0], r[1], r[3]) for r in landed], SCHEMA)
    found = reconcile.crawl_metadata(reconcile.category_domain(spark), pages).where("id = 1").collect()
    assert [tuple(r) for r in found] == [(1, 2, 2, 3)]
