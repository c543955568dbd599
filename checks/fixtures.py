"""Catalog, metadata, progress and listing pages derived from the driver tables.

Everything is computed from whole tables.  Ids, pages and positions are plain
arithmetic on the order key, so the catalog needs no shuffle; category 1 holds a
third of all rows, category 12 has none.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS_PAGE = 30
# Orders above this total count as the rows found on a page; some pages have none.
LARGE_TOTAL = 450_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their category, page and position."""
    key = F.col("o_orderkey")
    other = _div(key, 3) * 2 + key % 3 - 1
    category = F.when(key % 3 == 0, 1).otherwise(2 + other % 10).cast("int")
    rank = F.when(key % 3 == 0, _div(key, 3)).otherwise(_div(other, 10))
    return (
        table(spark, sf_dir, "orders")
        .withColumn("id", category)
        .withColumn("page", (_div(rank, ITEMS_PAGE) + 1).cast("int"))
        .withColumn("pos", (rank % ITEMS_PAGE).cast("int"))
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of two landings, with NULL and repeated protocols."""
    key = F.col("o_orderkey").cast("string")
    partner = F.when(F.col("o_custkey") % 5 == 0, " & Co <é>").otherwise("")
    protocol = (
        F.when(F.col("o_orderkey") % 500 == 0, None)
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("P"), key))
    )
    return placed_orders(spark, sf_dir).select(
        "id",
        "page",
        F.concat(F.lit("Drug "), F.col("o_custkey").cast("string"), partner).alias("drug"),
        F.concat(F.lit("#/item/?a=1&k="), key).alias("link"),
        F.col("o_orderpriority").alias("company"),
        protocol.alias("protocol"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("pub_date"),
        F.when(F.col("page") % 3 == 0, 1).otherwise(0).alias("batch"),
        "pos",
    )


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).groupBy("id", "page").agg(F.count("*").alias("n"))


def found_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large orders per page; pages without any are empty pages."""
    return (
        placed_orders(spark, sf_dir)
        .groupBy("id", "page")
        .agg(F.count_if(F.col("o_totalprice") >= LARGE_TOTAL).alias("n"))
    )


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as crawled: 1 is too low, 2 too high, 7 was filed under 12."""
    sizes = page_counts(spark, sf_dir).groupBy("id").agg(F.max("page").alias("last_page"), F.sum("n").alias("rows"))
    drift = F.when(F.col("id") == 1, -10).when(F.col("id") == 2, 10).otherwise(0)
    return sizes.select(
        F.when(F.col("id") == 7, 12).otherwise(F.col("id")).alias("id"),
        F.lit(ITEMS_PAGE).alias("items_page"),
        "last_page",
        (F.col("rows") + drift).cast("bigint").alias("size"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of saved pages: 2 is finished, 3 has another page size, 12 no entry."""
    user = F.col("user_id") % 11
    return table(spark, sf_dir, "events").select(
        (user + 1).cast("int").alias("category_id"),
        F.when(user == 1, 20).otherwise(1 + F.col("event_id") % 19).cast("int").alias("current_page"),
        F.lit(20).alias("last_page"),
        F.when(user == 2, ITEMS_PAGE - 1).otherwise(ITEMS_PAGE).alias("saved_size"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def _escaped(column: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = f"replace({column}, '{char}', '{entity}')"
    return column


_HEAD = (
    '<html><head><script>var s = "<table><tr><td>0</td></tr></table>";</script></head><body>'
    "<!-- <table><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></table> -->"
    '<div class="ng-table-counts btn-group"><button type="button" class="btn">10</button>'
    f'<button type="button" class="btn active"> <span>{ITEMS_PAGE}</span> </button></div>'
    '<table class="table" data-note="a > b"><thead><tr><th>#</th><th>Drug</th></tr></thead><tbody>'
)
_TAIL = (
    '<tr><td colspan="5">bad</td></tr></tbody></table>'
    "<table><tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></table>"
)


_LINE = f"""concat('<tr ng-repeat="row in data"><td><input type="checkbox"></td><td><a class="x" href="',
    {_escaped("link")}, '">\\n <b>', {_escaped("drug")}, '</b> </a></td><td>',
    {_escaped("company")}, '</td><td>', coalesce({_escaped("protocol")}, '&nbsp;'), '</td><td> ', pub_date, '\\t</td></tr>')"""

_PAGER = """concat('<ul class="pagination ng-table-pagination"><li class="active"><a href="#"><span>', page,
    '</span></a></li><li><a href="#"> <span>', least(page + 1, last_page),
    '</span> </a></li><li><a ng-switch-when="last" href="#"> ', last_page, '</a></li></ul></body></html>')"""


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered page per (id, page); a page has at most ``ITEMS_PAGE`` rows."""
    rows = catalog(spark, sf_dir)
    last = F.broadcast(rows.groupBy("id").agg(F.max("page").alias("last_page")))  # 11 rows
    lines = rows.selectExpr("id", "page", "batch", "pos", f"{_LINE} as line")
    tables = lines.groupBy("id", "page", "batch").agg(F.expr("array_sort(collect_list(struct(pos, line)))").alias("lines"))
    html = f"concat('{_HEAD}', array_join(lines.line, '\\n'), '{_TAIL}', {_PAGER}) as html"
    return tables.join(last, "id").selectExpr("id", "page", "batch", html)
