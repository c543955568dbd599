"""Whole web pages: title, text by lines, and links, all in the order of the page.

Scripts, styles and comments hold no text and no markup, whatever they contain; they are
blanked first.  White space of the source is one space; lines are where block elements
begin or end.  Everything is an expression, so a page stays in the task that read it.

Defined results: a NULL page has a NULL title, no lines and no links; a page without a
title, or with a blank one, has a NULL title; unclosed elements run on to where the next
block begins; an anchor without ``href`` has a NULL target and is listed; an anchor that
is not closed is none.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.html import ATTRIBUTES, attributes_before, visible_markup
from pagemill.functions.text import blank_to_null, decode_entities, normalize_space, strip

# Elements that begin and end a line.
BLOCKS = (
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead title tr ul"
).split()
_BLOCK = rf"(?i)</?(?:{'|'.join(BLOCKS)})(?=[\s>/]){ATTRIBUTES}>"
_HEAD = r"(?is)<head(?=[\s>]).*?(?:</head\s*>|(?=<body[\s>])|\z)"
_ANY_TAG = rf"<(?:![^>]*|/?[A-Za-z]{ATTRIBUTES})>"
_ANCHOR = rf"(?is)<a(?=[\s>]){ATTRIBUTES}>.*?</a(?=[\s>])"
_HREF = rf"""(?is)^<a{attributes_before("href")}\s+href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _one_line(markup: Column) -> Column:
    """The text of a piece of markup, in one line."""
    return strip(normalize_space(decode_entities(F.regexp_replace(markup, _ANY_TAG, ""))))


def title(visible: Column) -> Column:
    found = F.regexp_extract(visible, rf"(?is)<title(?=[\s>]){ATTRIBUTES}>(.*?)(?:</title(?=[\s>])|\z)", 1)
    return blank_to_null(_one_line(found))


def lines(visible: Column) -> Column:
    """The lines of the body that hold text."""
    body = F.regexp_replace(F.regexp_replace(visible, _HEAD, ""), "[ \\t\\r\\n\\f]+", " ")
    text = decode_entities(F.regexp_replace(F.regexp_replace(body, _BLOCK, "\n"), _ANY_TAG, ""))
    trimmed = F.transform(F.split(text, "\n"), lambda x: strip(normalize_space(x)))
    return F.coalesce(F.filter(trimmed, lambda x: x != ""), F.array().cast("array<string>"))


def _visible(pages: DataFrame) -> DataFrame:
    return pages.withColumn("visible", visible_markup(F.col("html")))


def page_title(pages: DataFrame) -> DataFrame:
    return _visible(pages).select("page_id", title(F.col("visible")).alias("title"))


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, n_lines, text): the lines of each page, one under the other."""
    found = _visible(pages).select("page_id", lines(F.col("visible")).alias("lines"))
    return found.select("page_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text): the anchors of each page, numbered from 0."""
    anchors = F.regexp_extract_all("visible", F.lit(_ANCHOR), F.lit(0))
    found = _visible(pages).select("page_id", F.posexplode(anchors).alias("pos", "anchor"))
    groups = [F.regexp_extract("anchor", _HREF, g) for g in (1, 2, 3)]
    href = F.when(F.rlike("anchor", F.lit(_HREF)), strip(decode_entities(F.concat(*groups))))
    inner = F.regexp_replace(F.regexp_replace("anchor", "(?is)</a$", ""), rf"(?is)^<a(?=[\s>]){ATTRIBUTES}>", "")
    return found.select("page_id", "pos", href.alias("href"), _one_line(inner).alias("text"))


def host(url: Column) -> Column:
    """The host of a web address in lower case, without a port; NULL if there is none."""
    return blank_to_null(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
