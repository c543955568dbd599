"""Expressions that read a listing page as a browser serialises it.

Markup of listings is flat, so tags are matched by regular expressions: a table
ends at its first closing tag, and so do rows and cells.  Comments, scripts and
styles hold no markup; they are blanked first but still separate text.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import decode_entities, strip

MIN_CELLS = 5

# Attributes up to the closing bracket; quoted values may hold a bracket.
ATTRIBUTES = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
_BLANKED = "<!>"
_COMMENT = r"!--[^-]*+(?:-(?!->)[^-]*+)*+-->"
_HIDDEN = rf"(?i)<(?:{_COMMENT}|(script|style)(?=[\s>])[^<]*+(?:<(?!/\1[\s>])[^<]*+)*+</\1\s*>)"
_TAG = rf"<(?:!|/?[A-Za-z]{ATTRIBUTES})>"
_MARK = "\x00"


def _open(tag: str) -> str:
    return rf"<{tag}(?=[\s>/]){ATTRIBUTES}>"


def attributes_before(attribute: str) -> str:
    """The attributes in front of the named one."""
    value = r"""(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?"""
    return rf"""(?:\s+(?!{attribute}[\s=/>])[^\s=/>"']++{value})*+"""


def _open_with(tag: str, attribute: str, text: str) -> str:
    """Opening tag whose attribute contains a text."""
    contains = rf"""\s+{attribute}\s*=\s*(?:"[^"]*(?-i:{text})|'[^']*(?-i:{text}))"""
    return rf"<{tag}(?={attributes_before(attribute)}{contains}){ATTRIBUTES}>"


def _content(tag: str) -> str:
    """Everything up to the first closing tag, taken run by run, not by character."""
    return rf"([^<]*+(?:<(?!/{tag}[\s>])[^<]*+)*+)"


def _element(tag: str, opening: str | None = None) -> str:
    return rf"(?i){opening or _open(tag)}{_content(tag)}</{tag}\s*>"


_TABLE = rf"(?i){_open('table')}{_content('table')}"
_ROW = _element("tr")
_CELL = _element("td")
_ANCHOR = rf"(?i){_open('a')}"
_ANCHOR_BODY = _element("a")
# The first anchor with, when it has one, the value of its target attribute.
_HREF = rf"""(?i)<a(?=[\s>/]){attributes_before('href')}(?:\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
_HREF_NAME = rf"(?i)<a(?=[\s>/]){attributes_before('href')}(\s+href[\s=/>])?"
_PAGER = _element("ul", _open_with("ul", "class", "pagination"))
_PAGER_ITEM = _element("li")
_PAGER_ACTIVE = _element("li", _open_with("li", "class", "active"))
_PAGER_LAST = _element("a", _open_with("a", "ng-switch-when", "last"))
_SIZES = _element("div", _open_with("div", "class", "ng-table-counts"))
_SIZE_ACTIVE = _element("button", _open_with("button", "class", "active"))


def visible_markup(html: Column) -> Column:
    """The page without the content of comments, scripts and styles.

    The other expressions of this module take markup that went through this.
    """
    return F.regexp_replace(html, _HIDDEN, _BLANKED)


def table_cells(markup: Column) -> Column:
    """Cells of each row of the first table; header rows have none."""
    table = F.regexp_extract(markup, _TABLE, 1)
    return F.transform(
        F.regexp_extract_all(table, F.lit(_ROW), F.lit(1)),
        lambda row: F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)),
    )


def whole_rows(markup: Column) -> Column:
    """Rows of the first table that have all the cells of a listing."""
    return F.filter(table_cells(markup), lambda cells: F.size(cells) >= MIN_CELLS)


def row_count(markup: Column) -> Column:
    """How many whole rows the first table has; a page without a table has 0."""
    return F.coalesce(F.size(whole_rows(markup)), F.lit(0))


def text_of(markup: Column) -> Column:
    """Text pieces between tags, each stripped, joined without a separator.

    ``split`` compiles its pattern for every text, unless it is one character, so
    tags are replaced by one that the text does not have.  Only a text with that
    character in it is split by the pattern.
    """
    by_mark = F.split(F.regexp_replace(markup, _TAG, _MARK), _MARK)
    pieces = F.when(F.contains(markup, F.lit(_MARK)), F.split(markup, _TAG)).otherwise(by_mark)
    text = F.array_join(F.transform(pieces, lambda piece: strip(decode_entities(piece))), "")
    return F.when(F.contains(markup, F.lit("<")), text).otherwise(F.coalesce(strip(decode_entities(markup)), F.lit("")))


def href_markup(markup: Column) -> Column:
    """The target of the first anchor as written, quotes included, else empty."""
    return F.regexp_extract(markup, _HREF, 1)


def first_href(markup: Column, written: Column) -> Column:
    """Target of the first anchor; NULL without an anchor or without a target.

    ``written`` is ``href_markup``; only without it the anchor is looked at
    again, since a target attribute may have no value.
    """
    quoted = F.rlike(written, F.lit("^[\"']"))
    value = F.when(quoted, F.substring(written, F.lit(2), F.length(written) - 2)).otherwise(written)
    return F.when(written != "", decode_entities(value)).when(
        F.regexp_extract(markup, _HREF_NAME, 1) != "", F.lit("")
    )


def next_page(current: Column, last: Column) -> Column:
    """The page after the current one, never beyond the last."""
    return F.least(current + 1, last)


def pager(markup: Column) -> Column:
    """Content of the first pager; empty when there is none."""
    return F.regexp_extract(markup, _PAGER, 1)


def current_page_markup(pager: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(pager, _PAGER_ACTIVE, 1), _ANCHOR_BODY, 1)


def last_page_markup(pager: Column) -> Column:
    return F.regexp_extract(pager, _PAGER_LAST, 1)


def linked_items(pager: Column) -> Column:
    """The pager items that hold a link."""
    items = F.regexp_extract_all(pager, F.lit(_PAGER_ITEM), F.lit(1))
    return F.filter(items, lambda item: F.rlike(item, F.lit(_ANCHOR)))


def size_markup(markup: Column) -> Column:
    """Content of the size button in use; NULL when there is none."""
    sizes = F.regexp_extract(markup, _SIZES, 1)
    return F.try_element_at(F.regexp_extract_all(sizes, F.lit(_SIZE_ACTIVE), F.lit(1)), F.lit(-1))
