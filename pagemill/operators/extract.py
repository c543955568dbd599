"""Listing pages to rows.

All operators here are narrow: one landed page becomes its rows in the task
that read it, without a shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.text import blank_to_null, is_number, normalize_space, to_number


def _listing_columns(rows: DataFrame) -> DataFrame:
    """Rows with their ``cells`` replaced by the listing columns.

    The first cell is a selector; the next four hold the listing.
    """
    kept = [c for c in rows.columns if c not in ("id", "page", "cells")]
    listing = F.slice("cells", 2, 4)
    texts = rows.withColumn("_href", H.href_markup(F.col("cells")[1])).withColumn(
        "_texts", F.transform(listing, H.text_of)
    )

    def text(place: int, name: str) -> Column:
        return blank_to_null(F.col("_texts")[place]).alias(name)

    return texts.select(
        "id",
        "page",
        text(0, "drug"),
        H.first_href(F.col("cells")[1], F.col("_href")).alias("link"),
        text(1, "company"),
        text(2, "protocol"),
        text(3, "pub_date"),
        *kept,
    )


def visible(pages: DataFrame) -> DataFrame:
    """Pages with ``html`` replaced by its visible ``markup``."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, H.visible_markup(F.col("html")).alias("markup"))


def with_pagination(pages: DataFrame) -> DataFrame:
    """Visible pages with the ``current``, ``next`` and ``last`` page they show.

    A page whose pager is missing, has texts that are no numbers, or offers no
    link to the next page counts as the only page of its category.

    Each step is a projection of its own, so that no step is evaluated, or
    planned, as many times as the next one mentions it.
    """
    kept = pages.columns
    pager = F.col("pager")
    texts = F.concat(F.array(H.current_page_markup(pager), H.last_page_markup(pager)), H.linked_items(pager))
    steps = (
        pages.withColumn("pager", H.pager(F.col("markup")))
        .select(*kept, F.transform(texts, H.text_of).alias("texts"))
        .select(
            *kept,
            to_number(F.col("texts")[0]).alias("shown"),
            to_number(F.col("texts")[1]).alias("end"),
            F.transform(F.slice("texts", 3, F.size("texts")), normalize_space).alias("linked"),
        )
        .withColumn("following", H.next_page(F.col("shown"), F.col("end")))
    )
    found = (
        F.col("shown").isNotNull()
        & F.col("end").isNotNull()
        & F.array_contains("linked", F.coalesce(F.col("following").cast("string"), F.lit("")))
    )
    states = steps.withColumn("found", found)

    def shown_or_one(name: str) -> Column:
        return F.when(F.col("found"), F.col(name)).otherwise(F.lit(1))

    return states.select(
        *kept,
        shown_or_one("shown").alias("current"),
        shown_or_one("following").alias("next"),
        shown_or_one("end").alias("last"),
    )


def with_items_page(pages: DataFrame) -> DataFrame:
    """Visible pages with the page size in use; 0 when none is shown."""
    sized = pages.withColumn("_size", H.text_of(H.size_markup(F.col("markup"))))
    return sized.withColumn("items_page", F.coalesce(to_number(F.col("_size")), F.lit(0))).drop("_size")


def extract_listing_rows(pages: DataFrame) -> DataFrame:
    """Catalog rows of ``pages(id, page, html, ...)``; other columns are kept.

    ``pos`` is the place of the row among the whole rows of its page.  Pages
    without a table or without whole rows give no rows.
    """
    kept = [c for c in pages.columns if c not in ("id", "page", "html")]
    rows = visible(pages).select(
        "id", "page", *kept, F.posexplode(H.whole_rows(F.col("markup"))).alias("pos", "cells")
    )
    return _listing_columns(rows)


def extract_chunk_rows(pages: DataFrame) -> DataFrame:
    """Chunk rows of landed pages: catalog rows plus the announced last page; other columns are kept.

    A page without whole rows gives one row whose ``pos`` is NULL, so that the
    stop at the first empty page can be decided without parsing the page again.
    """
    kept = [c for c in pages.columns if c not in ("id", "page", "html")]
    rows = with_pagination(visible(pages)).select(
        "id",
        "page",
        *kept,
        F.col("last").alias("last_page"),
        F.posexplode_outer(H.whole_rows(F.col("markup"))).alias("pos", "cells"),
    )
    return _listing_columns(rows)


def malformed_rows(pages: DataFrame) -> DataFrame:
    """Rows with some cells but too few: their index in the table and cell count."""
    rows = visible(pages).select("id", "page", F.posexplode(H.table_cells(F.col("markup"))).alias("row", "cells"))
    counted = rows.select("id", "page", "row", F.size("cells").alias("found"))
    return counted.where(F.col("found").between(1, H.MIN_CELLS - 1))


def page_states(pages: DataFrame) -> DataFrame:
    """Pagination state and page size that each landed page shows."""
    states = with_items_page(with_pagination(visible(pages)))
    return states.select("id", "page", "current", "next", "last", "items_page")


def numeric_guard(rows: DataFrame, text: str, number: str = "number") -> DataFrame:
    """Rows with ``text`` checked: ``valid`` and the parsed ``number``, NULL if rejected."""
    return rows.select("*", is_number(F.col(text)).alias("valid"), to_number(F.col(text)).alias(number))
