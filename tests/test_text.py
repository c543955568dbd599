from html import unescape

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X


def values(spark, texts, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(function(F.col("t")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_strip_is_the_unicode_strip(spark):
    texts = ["  a ", "\xa0a\xa0b ", "\t\n", "", None, "​a", "é\x85", "﻿a "]
    assert values(spark, texts, X.strip) == [None if t is None else t.strip() for t in texts]


def test_normalize_space_keeps_no_break_space(spark):
    assert values(spark, [" a \n b\t", "\xa0a"], X.normalize_space) == ["a b", "\xa0a"]


@pytest.mark.parametrize("wrap", ["{}", "x{}y", "{0}{0}"])
def test_entities_decode_once(spark, wrap):
    texts = [
        wrap.format(t)
        for t in ("&amp;lt;", "&lt;b&gt;", "&nbsp;", "&quot;", "&eacute;", "&#233;", "&#xE9;", "&#38;lt;", "a & b", "&unknown;", "&#x1F600;", "&;", "&apos;&amp;&copy;")
    ]
    assert values(spark, texts, X.decode_entities) == [unescape(t) for t in texts]


def test_numbers_are_ascii_digits(spark):
    texts = ["12", "007", "²", "½", "٣", "", None, "-1", "1.0", "99999999999", " 1"]
    assert values(spark, texts, X.is_number) == [True, True] + [False] * 7 + [True, False]
    assert values(spark, texts, X.to_number) == [12, 7] + [None] * 9


def test_pub_date_and_json(spark):
    import datetime

    assert values(spark, ["31/12/2020", "2020-12-31", "31/02/2020", None], X.pub_date) == [datetime.date(2020, 12, 31), None, None, None]
    field = lambda c: X.json_field(c, "product.leaflet")
    assert values(spark, ['{"product": {"leaflet": "x"}}', "{}", "no"], field) == ["x", None, None]


def test_first_line_and_url(spark):
    assert values(spark, ["a\nb", "a\r\nb", "a"], X.first_line) == ["a", "a", "a"]
    url = values(spark, ["7"], lambda c: X.category_url(c.cast("int")))[0]
    assert url.endswith("?categoriasRegulatorias=7")


def test_entities_of_any_length(spark):
    texts = ["&#00000065;", "&#x0000000041;", "&#150;", "&#129;", "a\uffffb &#8364;", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFF;", "&#0;", "& &amp;lt; &"]
    wanted = ["A", "A", "\u2013", "\x81", "a\uffffb \u20ac", "\ufffd", "\ufffd", "\ufffd", "& &lt; &"]
    assert values(spark, texts, X.decode_entities) == wanted


def test_text_between_tags_with_the_mark_in_it(spark):
    from pagemill.functions import html as H

    cells = ["a\x00 b<b> c \x00</b> d", " a<b> \x00 </b>\x00", "\x00", " x\x00 ", "a <i> $1 \\ </i> b", "<b></b>", " &lt;b> ", None, ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").repartition(2)
    found = [r.t for r in df.select("i", H.text_of(F.col("c")).alias("t")).orderBy("i").collect()]
    assert found == ["a\x00 bc \x00d", "a\x00\x00", "\x00", "x\x00", "a$1 \\b", "", "<b>", "", ""]
